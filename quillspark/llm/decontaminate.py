"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every text is cut into words; the hashes of its k-grams (k = 5) are winnowed:
of each window of ``w`` consecutive hashes the least is kept, the leftmost of
equals.  Two texts that share a span of ``k + w - 1`` words keep the same
fingerprint in it, so with k = 5 and w = 6 no shared run of ten words is
missed.  Items of fewer words are one window and have fingerprints of their
own: for 5 to 9 words ``w`` shrinks to fit, for 1 to 4 words the k-gram is the
whole item; they don't make those of longer items any denser.

Fingerprints of training and test texts are joined by hash, then every hit is
extended word by word to both sides, which also settles hash collisions.  Only
documents with hits are read again for that.

Defined results: null or wordless texts have no words, hits or windows.
Repeated document rows each get their row, and are looked at once.  Repeated item rows with one id are
one item; an item without an id marks words but is not listed.  An empty
benchmark leaves every document clean.  Very long texts are whole like others.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .keyfilter import marked, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5
#: A fingerprint is 33 bits of hash over 30 bits of position.
POSITION_BITS = 30
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_A_WORD), "")


def grams(k: int, of: str = "words") -> Column:
    """Positioned hashes of all k-grams: 33 bits of hash, then the position."""
    parts = ", ".join(f"{of}[i + {j}]" for j in range(k))
    return F.expr(
        f"""if(size({of}) < {k}, array(), transform(sequence(0, size({of}) - {k}),
        i -> shiftleft(xxhash64({parts}, size({of}) - size({of})) & {(1 << 33) - 1}L, {POSITION_BITS}) | cast(i as bigint)))"""
    )


def least_over(df: DataFrame, of: str, w: int) -> DataFrame:
    """``of`` becomes the distinct least values over all windows of ``w``; a shorter array is one window."""
    df, span = df.withColumn("__n", F.size(of)), 1
    while span < w:
        step = min(span, w - span)
        df = df.withColumn(of, F.expr(f"zip_with({of}, slice({of}, {step + 1}, size({of})), (a, b) -> least(a, b))"))
        span += step
    return df.withColumn(of, F.expr(f"array_distinct(slice({of}, 1, greatest(__n - {w - 1}, least(__n, 1))))")).drop("__n")


def schemes(items: DataFrame, window: int, gram: int) -> list[tuple[int, int]]:
    """(k, w) of the fingerprints, by the lengths of the items; at most ``window`` of them are told apart."""
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect() if r[0]]
    return sorted((min(gram, n), n - min(gram, n) + 1) for n in lengths)


def item_prints(items: DataFrame, k: int, w: int, window: int) -> DataFrame:
    """The fingerprints of the items whose windows have k + w - 1 words, with the words around each; equal contexts are one row."""
    parts = least_over(items.where(F.least(F.size("words"), F.lit(window)) == k + w - 1).withColumn("prints", grams(k)), "prints", w)
    reach = window - k
    at = parts.select("item_id", "words", F.explode_outer("prints").alias("p")).where("p is not null").withColumn("j", F.expr(f"cast(p & {(1 << POSITION_BITS) - 1}L as int)"))
    return (
        at.select(
            F.expr(f"shiftrightunsigned(p, {POSITION_BITS})").alias("h"),
            F.expr(f"reverse(slice(words, greatest(j - {reach}, 0) + 1, least(j, {reach})))").alias("before"),
            F.expr(f"slice(words, j + 1, {k})").alias("gram"),
            F.expr(f"slice(words, j + 1 + {k}, {reach})").alias("after"),
            F.least(F.size("words"), F.lit(window)).alias("need"),
            "item_id",
        )
        .groupBy("h", "before", "gram", "after", "need")
        .agg(F.collect_set("item_id").alias("items"))
    )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every document row, and (id, th, spans, items) of the documents that have hits.

    ``id`` is the doc_id, 0 for none, and ``th`` the hash of doc_id and text.  Spans (s, e) are those of hit words.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    some = schemes(items, window, gram)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("th"), F.col(text).alias("text"))
    split = texts.select("doc_id", "id", "th", words(F.col("text")).alias("words"))
    rows, hits = None, None
    # The longest scheme last, which is most often the only one: its fingerprints are written with the counts of words.
    for k, w in some:
        of_items = scratch.stage(item_prints(items, k, w, window), "items")
        own = least_over(split.withColumn("n_words", F.size("words")).withColumn("prints", grams(k)), "prints", w).drop("words")
        if (k, w) == some[-1]:
            own = rows = scratch.stage(own, "prints")
        # Not explode(): its inferred size filter would be pushed below the projections.
        own = own.select("id", "th", F.explode_outer("prints").alias("p")).where("p is not null")
        own = own.select("id", "th", F.expr(f"shiftrightunsigned(p, {POSITION_BITS})").alias("h"), F.expr(f"cast(p & {(1 << POSITION_BITS) - 1}L as int)").alias("i"))
        found = own.join(of_items, "h").select("id", "th", F.struct("i", "before", "gram", "after", "need", "items").alias("m"))
        found = scratch.stage(found, "found")
        hits = found if hits is None else hits.unionByName(found)
    if rows is None:
        rows = split.withColumn("n_words", F.size("words"))
    told = rows.select("doc_id", "id", "th", "n_words")
    if hits is None:
        return told, spark.createDataFrame([], "id long, th long, spans array<struct<s:int,e:int>>, items array<bigint>")
    # Repeated rows find the same hits.
    hits = scratch.stage(hits.distinct().groupBy("id", "th").agg(F.collect_list("m").alias("m")), "hits")
    run = "if(array_position({0}, false) = 0, size({0}), cast(array_position({0}, false) as int) - 1)"
    again = marked(texts.select("id", "th", "text"), hits, ["id", "th"]).where("maybe").dropDuplicates(["id", "th"])
    # Split below the join: above it, every use of the words would split the text again.
    again = again.select("id", "th", words(F.col("text")).alias("words"))
    spans = (
        again.join(hits, ["id", "th"])
        .withColumn(
            "m",
            F.expr(
                """transform(filter(m, x -> slice(words, x.i + 1, size(x.gram)) = x.gram), x -> struct(x.i as i, size(x.gram) as k, x.need as need, x.items as items,
                zip_with(reverse(slice(words, greatest(x.i - size(x.before), 0) + 1, least(x.i, size(x.before)))), x.before, (a, b) -> coalesce(a = b, false)) as l,
                zip_with(slice(words, x.i + 1 + size(x.gram), size(x.after)), x.after, (a, b) -> coalesce(a = b, false)) as r))"""
            ),
        )
        .withColumn("m", F.expr(f"transform(m, x -> struct(x.i - {run.format('x.l')} as s, x.i + x.k + {run.format('x.r')} as e, x.need as need, x.items as items))"))
        .withColumn("m", F.expr("filter(m, x -> x.e - x.s >= x.need)"))
        .select(
            "id", "th",
            # Spans as longs: structs would be told apart pair by pair.
            F.expr("transform(sort_array(array_distinct(transform(m, x -> shiftleft(cast(x.s as bigint), 32) | x.e))), x -> struct(cast(shiftright(x, 32) as int) as s, cast(x & 4294967295L as int) as e))").alias("spans"),
            F.expr("array_distinct(flatten(transform(m, x -> x.items)))").alias("items"),
        )
    )
    return told, scratch.stage(spans.where("size(spans) > 0"), "spans")


#: Words covered by sorted spans.
COVERED = "aggregate(spans, struct(0L as n, 0 as upto), (a, x) -> struct(a.n + greatest(x.e - greatest(x.s, a.upto), 0) as n, greatest(a.upto, x.e) as upto), a -> a.n)"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, and the items that occur."""
    rows, spans = contaminated_spans(docs, benchmark, window, gram)
    items = F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')")
    found = spans.select("id", "th", F.expr(COVERED).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"))
    return rows.join(found, ["id", "th"], "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id="doc_id", text="text") -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    _, spans = contaminated_spans(docs, benchmark, window, gram, doc_id, text)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("th"))
    return without(rows, spans.select("id", "th"), ["id", "th"]).select("row.*")
