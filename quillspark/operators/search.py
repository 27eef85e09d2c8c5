"""Retrieval over documents: BM25L and keyword scores as algebra on postings.

A document's score is the sum of every query term's score at zero occurrences
plus, for its own postings, what the term adds to that, which is never
negative.  So texts are read once, for their lengths and the query terms they
hold; everything else comes from that small table, and the best documents are
sought among those that hold a term, and only where these are too few among
others, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources import workspace

K1, B, DELTA = 1.5, 0.75, 0.5
#: Query terms that a scan of the texts looks for.
TERMS_A_SCAN = 512


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """(term, df): documents that hold each term (AGG35); each sends a term once, and counts are summed before the shuffle."""
    # explode_outer: the size filter that explode() infers would cut the text a second time.
    terms = docs.select(F.explode_outer(F.array_distinct(T.tokens(text))).alias("term")).where("term is not null")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: documents n and mean length avgdl (AGG35)."""
    return docs.select(F.size(T.tokens(text)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def held_terms(docs: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """(key, dl, held): every document's length and its occurrences of the terms, written once."""
    path = workspace.fresh(docs.sparkSession, "held")
    for at in range(0, max(1, len(terms)), TERMS_A_SCAN):
        some = F.array(*map(F.lit, terms[at : at + TERMS_A_SCAN])).cast("array<string>")
        # In one lambda the tokens are cut once; as a column of their own they would be for each use.
        told = F.transform(F.array(T.tokens(text)), lambda t: F.struct(F.size(t).cast("long").alias("dl"), F.filter(t, lambda x: F.array_contains(some, x)).alias("held")))[0]
        docs.select(key, told.alias("x")).select(key, "x.*", F.lit(at).alias("scan")).write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def gains(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For queries (query_id, query) with a known term: (query_id, base), (query_id, key, extra) of documents that hold a term, and all keys.

    Query terms keep their multiplicity; the queries' distinct terms go to the driver.
    """
    terms = queries.select("query_id", F.explode(T.tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = held_terms(docs, key, text, sorted(r.term for r in terms.select("term").distinct().collect()))
    whole = rows.where("scan = 0")
    stats = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    found = rows.where("size(held) > 0").select(key, "dl", F.explode("held").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = rows.where("size(held) > 0").select(F.explode(F.array_distinct("held")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # The statistics are one row.
    weighed = terms.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log(F.col("n") + 1.0) - F.log(F.col("df") + 0.5))
    gain = lambda ctd: F.col("idf") * F.col("qtf") * (K1 + 1) * (ctd + DELTA) / (K1 + ctd + DELTA)
    base = weighed.groupBy("query_id").agg(F.sum(gain(F.lit(0.0))).alias("base"))
    ctd = F.col("tf") / (1 - B + B * F.col("dl") / F.col("avgdl"))
    extra = found.join(weighed, "term").groupBy("query_id", key).agg(F.sum(gain(ctd) - gain(F.lit(0.0))).alias("extra"))
    return base, extra, whole.select(key)


def bm25l(docs: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of all documents for queries (query_id, query) with a known term.

    The result itself has a row for each query and document; see :func:`bm25l_best` for the first ones.
    """
    base, extra, keys = gains(docs, key, text, queries)
    return keys.join(base).join(extra, ["query_id", key], "left").select("query_id", key, (F.col("base") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def bm25l_best(docs: DataFrame, key: str, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, score): each query's k best documents, the later key first among equals (to 8 digits).

    A document without any of a query's terms scores less than all that hold
    one, so such documents count only where fewer than k hold any; then those
    of the greatest keys do.
    """
    base, extra, keys = gains(docs, key, text, queries)
    by_rank = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), F.desc(key))
    scored = extra.join(base, "query_id").select("query_id", key, (F.col("base") + F.col("extra")).alias("score"))
    first = scored.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).drop("rank")
    last = keys.orderBy(F.desc(key)).limit(2 * k)
    short = base.join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    others = F.broadcast(last).join(short.select("query_id", F.col("base").alias("score"))).join(first.select("query_id", key), ["query_id", key], "left_anti")
    every = first.unionByName(others.select("query_id", key, "score"))
    return every.withColumn("rank", F.row_number().over(by_rank).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def keyword_score(content: Column, heading: Column, words: list[str]) -> Column:
    """Occurrences in the content and five for each in the heading, over all words (TOP03); callers pass lower-case columns."""
    score = F.lit(0).cast("long")
    for w in words:
        score = score + T.occurrences(content, w) + 5 * T.occurrences(heading, w)
    return score


def best(scored: DataFrame, k: int, *order, group: list[str] | None = None) -> DataFrame:
    """The first k rows by an order, overall or of each group."""
    if group is None:
        return scored.orderBy(*order).limit(k)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def distinct_content(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The row of least key of each exact content (SET05), for keys that stand once: hashes are shuffled, not texts, where the planner finds the keys to keep few."""
    keyed = docs.withColumn("__h", F.sha2(F.coalesce(text, F.lit("")), 256))
    first = keyed.groupBy("__h").agg(F.min(key).alias("__k"))
    return keyed.join(first.withColumnRenamed("__k", key), ["__h", key], "left_semi").drop("__h")
