"""N-gram Jaccard self-join of documents, with filters under several global token orders.

A document is the set of its word n-grams, as 64-bit hashes.  Documents of
equal sets are one class with one representative.  Under any global order of
the tokens, two sets of Jaccard similarity t or more share a token among the
first ``n - ceil(t n) + 1`` of each, and ``c`` tokens among ``c - 1`` more.
Candidates are drawn from the posting lists of one order and must pass the same
test under each other order; what is left is verified on the whole sets.

All orders put rare tokens first.  Exact document counts are taken of the
tokens of a hash zone, a share of the token space; tokens of the zone in at
most ``RARE`` classes come first, then all others; hash functions order them
within.  Hence most prefixes hold rare tokens only, whose posting lists are
short by construction, however common a passage is.

Classes with too few rare tokens in the zone are ranked again among
themselves, by counts of all their tokens.  Those that consist of frequent
tokens nearly whole (large families of near copies) are joined by the whole
order, less frequent tokens first: each posting list is compared with its most
central members, which link a family by stars, and pairs across different
components meet by the tokens in which they differ from that member.  Lists of
those are compared with ever more of their members, eight at first, and what
one component has come to hold is left out of the next round, so no link
between components is lost and no list is expanded into all its pairs but
where they all stay apart and pass every filter.

Defined results: texts that are null or without words have an empty set and
link with nothing.  A row without id has no component.  Repeated rows each get
their row; one id on rows of different texts stands for both, whose components
share the least id.  Very long texts are whole sets like others.  Empty tables
give empty results.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .decontaminate import LOWER, UPPER
from .keyfilter import marked, only, without

BLANK = r"[\x20\x09-\x0D]+"
#: Longest posting list that is expanded into pairs.
RARE = 32
#: Seeds of the token orders.
SEEDS = (1, 2, 3)
#: Percent of similarity to a leader from which on a node is near.
NEAR = 30
#: Members of a list of differences that the others are compared with in its first round, and by how much more in each next one.
COMPARED, MORE = 8, 8
#: Members of a family that meet their leader's set in one place.
SALTED = 1000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANK), "")


def with_shingles(df: DataFrame, n: int) -> DataFrame:
    """Adds ``sh``, the sorted distinct n-gram hashes of ``text``; a shorter text is one n-gram."""
    parts = ", ".join(f"w[i + {j}]" for j in range(n))
    return (
        df.withColumn("w", words(F.col("text")))
        .withColumn("sh", F.expr(f"if(size(w) < {n}, if(size(w) = 0, array(), array(xxhash64(w))), transform(sequence(0, size(w) - {n}), i -> xxhash64({parts})))"))
        .withColumn("sh", F.sort_array(F.array_distinct("sh")))
        .drop("w")
    )


class NgramJoin:
    """Links of Jaccard similarity ``percent``/100 or more, and their components."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.percent, self.spark = n, percent, docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        zone = min(1.0, 0.02 * (100 - percent))
        #: Tokens are hashes: below this bound they are in the counted zone.
        self.zone = f"x < {int(zone * 2**64) - 2**63}L" if zone < 1 else "true"
        sets = with_shingles(self.docs, n)
        sets = scratch.stage(
            sets.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size("sh").alias("n"), F.xxhash64("sh").alias("f"), F.expr(f"filter(sh, x -> {self.zone})").alias("zone")), "sets"
        )
        self.rows = scratch.stage(sets.select("doc_id", "text_hash", "n", "f"), "rows")
        #: One node a class of equal sets; f identifies it.
        some = "n > 0 and doc_id is not null"
        equal = scratch.stage(self.rows.where(some).groupBy("f").count().where("count > 1").select("f"), "equal")
        scratch.release(self.spark)
        # Most sets are those of one row: they are not shuffled.
        told = marked(sets.where(some), equal, ["f"])
        nodes = told.where("maybe").groupBy("f", "n").agg(F.min("doc_id").alias("rep"), F.first("zone").alias("zone"))
        self.nodes = scratch.stage(nodes.unionByName(told.where("not maybe").select("f", "n", F.col("doc_id").alias("rep"), "zone")), "nodes")
        scratch.release(self.spark, sets, equal)

    def common(self, n: str = "n") -> str:
        """Tokens that the prefixes of a linked pair must share at least."""
        return f"greatest(1, {100 - self.percent} * {n} div 250)"

    def prefix_size(self, n: str = "n", common: bool = True) -> str:
        """Tokens of a prefix: n - ceil(percent n / 100), and as many more as must be shared."""
        return f"cast({n} - ({self.percent} * {n} + 99) div 100 + {self.common(n) if common else 1} as int)"

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(f, sh) of some nodes, from the texts of their representatives.

        A filter of bounded size passes over nearly all other texts before the shuffle; the join by id is exact.
        """
        wanted = nodes.select("f", F.col("rep").alias("doc_id"))
        some = with_shingles(only(self.docs, wanted, ["doc_id"]).join(wanted, "doc_id"), self.n)
        # Tested on the written table: a filter on computed sets would be pushed down and compute them again.
        sets = scratch.stage(some.select("f", F.xxhash64("sh").alias("own"), "sh"), "whole")
        if sets.groupBy("f").count().where("count > 1").take(1):
            sets = scratch.stage(sets.where("own = f").dropDuplicates(["f"]), "whole")
        return sets

    def ranked(self, nodes: DataFrame) -> DataFrame:
        """Nodes (f, n, rep, zone) with ``rare`` (their rare tokens of the zone), ``common`` (level and token of its others) and ``hard`` (too few rare ones for a prefix)."""
        tokens = nodes.select("f", F.explode_outer("zone").alias("t")).where("t is not null")
        frequent = tokens.groupBy("t").count().where(F.col("count") > RARE).select("t", F.floor(F.log2("count")).cast("int").alias("level"))
        frequent = scratch.stage(frequent, "frequent")
        scratch.release(self.spark)
        # Nearly all tokens are rare: those are passed over before the shuffle.
        some = only(tokens, frequent, ["t"])
        met = scratch.stage(some.join(frequent, "t").groupBy("f").agg(F.collect_list(F.struct("level", "t")).alias("common")), "met")
        scratch.release(self.spark, frequent)
        # Nodes without any are not shuffled.
        told, none = marked(nodes, met, ["f"]), F.expr("cast(array() as array<struct<level:int,t:bigint>>)")
        told = told.where("maybe").join(met, "f", "left").unionByName(told.where("not maybe").withColumn("common", none))
        ranked = scratch.stage(
            told.withColumn("common", F.coalesce("common", none))
            .withColumn("rare", F.expr("array_except(zone, transform(common, x -> x.t))"))
            .withColumn("hard", F.expr(f"size(rare) < {self.prefix_size()}"))
            .select("f", "n", "rep", "rare", "common", "hard"),
            "ranked",
        )
        scratch.release(self.spark, met)
        return ranked

    def close_sizes(self, a: str, b: str) -> Column:
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def ordered(self, tokens: str, seed: int) -> str:
        """Tokens under the order of one hash seed."""
        return f"sort_array(transform({tokens}, x -> xxhash64(x, {seed}L)))"

    def candidates(self, ranked: DataFrame) -> DataFrame:
        """Pairs (a, b), not both hard, whose prefixes share enough rare tokens under each order."""
        prefix = ranked.withColumn("p", F.expr(f"slice({self.ordered('rare', SEEDS[0])}, 1, {self.prefix_size()})"))
        # A hard node has a negative size: one column less to move.
        posted = prefix.select("f", F.expr("if(hard, -n, n)").alias("n"), F.explode_outer("p").alias("t")).where("t is not null")
        # Dealt by token before the lists are made: lists of one take several times the room of a row.
        lists = posted.repartition(F.col("t")).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("m"))
        pairs = lists.where("size(m) > 1").select(
            F.explode_outer(
                F.expr(
                    f"""flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> (x.n > 0 or y.n > 0)
                    and 100 * least(abs(x.n), abs(y.n)) >= {self.percent} * greatest(abs(x.n), abs(y.n))), y -> struct(x.f as a, y.f as b, least(abs(x.n), abs(y.n)) as n))))"""
                )
            ).alias("pair")
        )
        pairs = pairs.where("pair is not null").select("pair.*").groupBy("a", "b").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c"))
        pairs = scratch.stage(pairs.where(f"c >= {self.common()}").select("a", "b", "n"), "pairs")
        scratch.release(self.spark)
        # The candidates of the first order meet the prefixes of the others.
        ends = pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct()
        others = [f"slice({self.ordered('rare', seed)}, 1, {self.prefix_size()})" for seed in SEEDS[1:]]
        prefixes = scratch.stage(only(ranked, ends, ["f"]).join(ends, "f", "left_semi").select("f", F.expr(f"array({', '.join(others)})").alias("q")), "prefixes")
        met = pairs.join(prefixes.select(F.col("f").alias("a"), F.col("q").alias("x")), "a").join(prefixes.select(F.col("f").alias("b"), F.col("q").alias("y")), "b")
        met = scratch.stage(met.where(f"forall(zip_with(x, y, (p, q) -> size(array_intersect(p, q))), s -> s >= {self.common()})").select("a", "b"), "pairs")
        scratch.release(self.spark, pairs, prefixes)
        return met

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by their whole sets."""
        pairs = scratch.stage(pairs.select("a", "b"), "verified")
        left = only(sets.select(F.col("f").alias("a"), F.col("sh").alias("x")), pairs, ["a"])
        right = only(sets.select(F.col("f").alias("b"), F.col("sh").alias("y")), pairs, ["b"])
        both = pairs.join(right, "b").join(left, "a")
        shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("s"), (F.size("x") + F.size("y")).alias("n"))
        links = scratch.stage(shared.where(f"100 * s >= {self.percent} * (n - s)").select("a", "b"), "links")
        scratch.release(self.spark, pairs)
        return links

    def joined(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among candidate pairs, enough of them to join all that are linked."""
        # A star first: of each node the pair with its least neighbour.
        links = self.verified(pairs.groupBy("b").agg(F.min("a").alias("a")), sets)
        roots = scratch.stage(components(links), "parts")
        root = lambda c: F.coalesce(f"root_{c}", c)
        left = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
        left = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left").where(root("a") != root("b"))
        links = links.unionByName(self.verified(left, sets))
        scratch.release(self.spark, roots)
        return links

    def with_roots(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows with the ``root`` of their node ``f`` among the links so far."""
        return rows.join(roots.select(F.col("node").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))

    def linked(self, roots: DataFrame, links: DataFrame) -> DataFrame:
        """(node, root) after more links (a, b)."""
        links = scratch.stage(links, "links")
        if not links.take(1):
            return roots
        return scratch.stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")

    def stars(self, posted: DataFrame, sets: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame]:
        """Compares the members of each list (t, f, n) with its leaders: (f, n, lead, s, all, d), and (t, f, n) of the members far from all of them.

        A list has a leader in each of ``leaders`` parts of it: the member that stands in most lists.
        """
        sizes = posted.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        weight = posted.join(sizes, "t").groupBy("f").agg(F.sum("c").alias("weight"))
        heavy = scratch.stage(posted.join(sizes, "t").join(weight, "f").withColumn("part", F.pmod(F.xxhash64("f"), F.lit(leaders))), "heavy")
        leads = heavy.groupBy("t", "part").agg(F.max(F.struct("weight", "f", "n")).alias("l")).select("t", F.col("l.f").alias("lead"), F.col("l.n").alias("ln"))
        led = heavy.select("t", "f", "n", "c").join(leads, "t")
        led = scratch.stage(led.select("t", "f", "n", "c", "lead", (F.expr("100 * least(n, ln)") >= NEAR * F.expr("greatest(n, ln)")).alias("even")), "led")
        scratch.release(self.spark, heavy)
        # A large family meets copies of its leader's set in many places.
        salts = F.ceil(F.col("c") / SALTED)
        met = led.where("even").groupBy("f", "n", "lead").agg(F.max("c").alias("c")).withColumn("salt", F.pmod(F.xxhash64("f"), salts)).drop("c")
        leading = led.where("even").groupBy("lead").agg(F.max("c").alias("c"))
        copies = leading.join(only(sets.select(F.col("f").alias("lead"), F.col("sh").alias("y")), leading, ["lead"]), "lead")
        copies = copies.select("lead", "y", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        both = met.join(only(sets.select("f", F.col("sh").alias("x")), led.where("even"), ["f"]), "f").join(copies, ["lead", "salt"])
        both = both.withColumn("s", F.size(F.array_intersect("x", "y"))).withColumn("all", F.size("y") + F.col("n") - F.col("s"))
        differ = F.expr(f"if(100 * s >= {NEAR} * `all`, concat(array_except(x, y), array_except(y, x)), array())")
        stars = scratch.stage(both.select("f", "n", "lead", "s", "all", differ.alias("d")), "stars")
        # Similarity to a leader differs by no more than 1 - t within a link.
        far = NEAR + 101 - self.percent
        missed = led.join(stars.select("f", "lead", "s", "all"), ["f", "lead"], "left").withColumn("far", F.expr(f"not even or 100 * s < {far} * `all`"))
        missed = scratch.stage(missed.groupBy("t", "f", "n").agg(F.bool_and("far").alias("far")).where("far").select("t", "f", "n"), "posted")
        scratch.release(self.spark, led)
        return stars, missed

    def apart(self, stars: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the nodes near a leader: (lead, f, n, d, q), their differences from it, and (lead, u, f, n, k, at), the postings of these.

        Rarer differences come first; a node posts those in which it may
        differ from a linked node, where nodes of other components post, too.
        """
        near = stars.where("size(d) > 0").select("lead", "f", "n", "d")
        posted = self.with_roots(near, roots).select("lead", "f", "root", F.explode_outer("d").alias("u"))
        counts = posted.groupBy("lead", "u").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        told = F.collect_list(F.struct("c", "u", (F.col("low") != F.col("high")).alias("open"))).alias("told")
        told = posted.select("lead", "f", "u").join(counts, ["lead", "u"]).groupBy("lead", "f").agg(told)
        most = f"cast(n * {100 - self.percent} div {self.percent} + 1 as int)"
        orders = ", ".join(f"transform(slice(sort_array(transform(told, x -> struct(floor(log2(x.c)) as level, xxhash64(x.u, {seed}L) as h))), 1, {most}), x -> x.h)" for seed in SEEDS[1:])
        nodes = near.join(told, ["lead", "f"]).select("lead", "f", "n", "d", F.expr(f"array({orders})").alias("q"), F.expr(f"slice(sort_array(told), 1, {most})").alias("first"))
        nodes = scratch.stage(nodes, "near")
        first = nodes.select("lead", "f", "n", F.size("d").alias("k"), F.posexplode_outer("first").alias("at", "x")).where("x.open")
        return nodes.drop("first"), scratch.stage(first.select("lead", F.col("x.u").alias("u"), "f", "n", "k", "at"), "apart")

    def rounds(self, nodes: DataFrame, posted: DataFrame, roots: DataFrame) -> DataFrame:
        """The roots after all links across components among nodes near a leader.

        x and y differ in d(x) + d(y) - 2 |D(x) & D(y)| <= B tokens, and what
        stands before their first common difference, at i and j, is not
        common: i + j <= B, 2 i <= B + d(x) - d(y) and 2 j <= B + d(y) - d(x).
        So the one with fewer differences has its place within B / 2, and
        meets the places up to B - j of the other, in doubling ranges.
        """
        p, most = self.percent, f"(n * {100 - self.percent} div {self.percent} + 1)"
        place = lambda at: f"cast(floor(log2({at} + 1)) as int)"
        posted, compared = posted.withColumn("used", F.expr(f"at > {most} div 2")), COMPARED
        while True:
            rows = self.with_roots(posted, roots)
            lists = rows.groupBy("lead", "u").agg(F.count_if(~F.col("used")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high and c > 0").select("lead", "u", "c")
            rows = scratch.stage(rows.join(lists, ["lead", "u"]), "open")
            if not rows.take(1):
                return roots
            fresh = rows.where("not used").withColumn("part", F.pmod(F.xxhash64("f"), F.lit(compared)))
            best = fresh.where(F.col("c") > compared).groupBy("lead", "u", "part").agg(F.min(F.struct("k", "f")).alias("b"))
            some = fresh.where(F.col("c") <= compared).select("lead", "u", "f").unionByName(best.select("lead", "u", F.col("b.f").alias("f")))
            some = scratch.stage(some, "compared")
            own = rows.join(some, ["lead", "u", "f"]).withColumn("place", F.explode(F.expr(f"sequence(0, {place(f'greatest({most} - at, 0)')})")))
            own = own.select("lead", "u", "place", *(F.col(c).alias(c + "y") for c in ("f", "n", "root", "k", "at")))
            other = rows.withColumn("place", F.expr(place("at"))).select("lead", "u", "place", *(F.col(c).alias(c + "x") for c in ("f", "n", "root", "k", "at")))
            differ = f"({100 - p} * (nx + ny) div {100 + p})"
            pairs = own.join(other, ["lead", "u", "place"]).where(f"rootx <> rooty and (ky < kx or (ky = kx and fy < fx)) and 2 * aty <= {differ} + ky - kx and 2 * atx <= {differ} + kx - ky")
            pairs = pairs.where(self.close_sizes("nx", "ny")).select("lead", "fx", "fy").distinct()
            left, right = (nodes.select("lead", *(F.col(c).alias(c + k) for c in ("f", "n", "d", "q"))) for k in "xy")
            both = pairs.join(left, ["lead", "fx"]).join(right, ["lead", "fy"]).where("forall(zip_with(qx, qy, (p, q) -> arrays_overlap(p, q)), x -> x)")
            both = both.withColumn("differ", F.expr("size(dx) + size(dy) - 2 * size(array_intersect(dx, dy))")).where(f"100 * (nx + ny - differ) >= {p} * (nx + ny + differ)")
            roots = self.linked(roots, both.select(F.col("fx").alias("a"), F.col("fy").alias("b")).distinct())
            # What has been compared stays for the others to meet, but is not taken again.
            done = some.withColumn("done", F.lit(True))
            posted = rows.join(done, ["lead", "u", "f"], "left").where(f"not (c <= {compared})")
            posted = scratch.stage(posted.select("lead", "u", "f", "n", "k", "at", (F.col("used") | F.coalesce("done", F.lit(False))).alias("used")), "posted")
            scratch.release(self.spark, rows, some)
            compared *= MORE

    def hard_links(self, ranked: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among nodes of frequent tokens, enough of them to join all that are linked.

        Each posting list has leaders, and members are compared with them.  Let
        D(x) be the tokens in which x and a leader differ.  Then x and y
        differ in d(x) + d(y) - 2 |D(x) & D(y)| tokens, and may differ in no
        more than B = (1 - t) / (1 + t) (n(x) + n(y)).  If d(x) + d(y) <= B,
        both are linked with the leader, so the stars join them.  Otherwise
        they share (d(x) + d(y) - B) / 2 or more tokens of D(x) and D(y), which
        are rare even if those of x and y are not, and meet by the prefixes of
        these sets.  That covers pairs near the leader; as similarity to it
        differs by no more than 1 - t within a link, the nodes of other pairs
        are both far from it, and their lists get twice as many leaders from
        among them in the next round, until all have been leaders.
        """
        common = f"transform(sort_array(transform(common, x -> struct(x.level as level, xxhash64(x.t, {SEEDS[0]}L) as h))), x -> x.h)"
        prefix = f"slice(concat({self.ordered('rare', SEEDS[0])}, {common}), 1, {self.prefix_size(common=False)})"
        posted = scratch.stage(ranked.select("f", "n", F.explode_outer(F.expr(prefix)).alias("t")).where("t is not null"), "posted")
        roots, leaders = self.spark.createDataFrame([], "node long, root long"), 1
        while posted.groupBy("t").count().where("count > 1").take(1):
            stars, posted = self.stars(posted, sets, leaders)
            roots = self.linked(roots, stars.where(f"f <> lead and 100 * s >= {self.percent} * `all`").select(F.col("f").alias("a"), F.col("lead").alias("b")))
            nodes, lists = self.apart(stars, roots)
            roots = self.rounds(nodes, lists, roots)
            scratch.release(self.spark, stars)
            leaders *= 2
        return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    def links(self) -> DataFrame:
        """Verified links (a, b) between classes, enough of them to tell the components.

        Nodes that are hard by the tokens of the zone are ranked again among
        themselves, by counts of all their tokens; those that are hard still
        consist of frequent tokens nearly whole.
        """
        nodes, ranked = self.nodes, self.ranked(self.nodes)
        self.nodes = scratch.stage(ranked.select("f", "rep"), "nodes")
        scratch.release(self.spark, nodes)
        pairs = self.candidates(ranked)
        hard = scratch.stage(ranked.where("hard").select("f", "n", "rep"), "hard")
        scratch.release(self.spark, ranked)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("f")).unionByName(hard.select("f")).distinct()
        sets = self.sets_of(scratch.stage(only(self.nodes, ends, ["f"]).join(ends, "f", "left_semi"), "ends"))
        links = self.joined(pairs, sets)
        if not hard.take(1):
            return links
        ranked = self.ranked(scratch.stage(hard.join(only(sets.select("f", "sh"), hard, ["f"]), "f").withColumnRenamed("sh", "zone"), "hard"))
        links = links.unionByName(self.joined(self.candidates(ranked), sets))
        if ranked.where("hard").take(1):
            links = links.unionByName(self.hard_links(ranked.where("hard"), sets))
        scratch.release(self.spark, ranked, sets, hard)
        return links

    def members(self) -> DataFrame:
        """(f, root, least): the component of each class, by a class of it, and the least id there."""
        parts = components(self.links())
        nodes = self.nodes.join(parts.select(F.col("node").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))
        return scratch.stage(nodes.join(nodes.groupBy("root").agg(F.min("rep").alias("least")), "root").select("f", "root", "least"), "classes")

    def classes(self) -> DataFrame:
        """Per document row: doc_id, n_shingles, component_id (least doc_id it reaches)."""
        return self.rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "f").join(self.members(), "f", "left").select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"),
        )

    def survivors(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, text_hash) of the rows to leave out, and of those to keep that stand more than once."""
        rows = self.rows.where("n > 0 and doc_id is not null").groupBy("f", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c"))
        rows = scratch.stage(rows.join(self.members(), "f").select("doc_id", "text_hash", "root", "c"), "members")
        first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        told = rows.join(first, "root").select("doc_id", "text_hash", "c", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"))
        gone = scratch.stage(told.where("not stays").select("doc_id", "text_hash"), "gone")
        return gone, scratch.stage(told.where("stays and c > 1").select("doc_id", "text_hash"), "twice")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the size of their n-gram set and their component under Jaccard links."""
    return NgramJoin(docs, n, percent, id_col, text_col).classes()


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component, with their columns.

    The row with the least id stays, and of the rows of that id the one with
    the least hash of its text, so of repeated rows one.  Rows of one id with
    different texts are told apart: each stays or goes with its own text.
    Rows without id and rows without words link with nothing and stay.
    """
    gone, twice = NgramJoin(docs, n, percent, id_col, text_col).survivors()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    kept = without(rows, gone, ["doc_id", "text_hash"])
    if twice.take(1):
        repeated = kept.join(twice, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(twice, ["doc_id", "text_hash"], "left_anti").unionByName(repeated)
    return kept.select("row.*")
