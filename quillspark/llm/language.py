"""Language identification by Bayesian evidence fusion.

The log-odds of a page's languages add up

* the text's likelihood under byte-trigram models, fitted on a bounded sample
  of labelled documents and tempered, as trigrams overlap;
* the declared markup language, by how often it goes with each language;
* a prior of its host, smoothed towards its domain's, that towards its address
  suffix's, and that towards the whole corpus's.  The counts behind it are
  sums of text posteriors over all rows, by grouped aggregation; a row's own
  share is taken out again.

A row is rejected (language ``und``) if its text has hardly any letters or is
unlike all the languages, or if no language has more than half of the odds.

Defined results: null or empty texts are ``und``; null hosts share one prior;
an undeclared or unknown markup language is no evidence.  Letters are sought in
the whole text, however long.  Repeated rows get equal results, but for the
share that each takes out, which is its own.  Ties go to the language of the
lesser name.  Without labelled documents there are no languages and all rows
are ``und``.  Empty tables give empty results.  Columns of the input may have
any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import scratch, tokens
from .keyfilter import without

#: Labelled documents a language that fit the text model, and the most languages that its table is made for; more raise an error.
SAMPLE, MAX_LANGUAGES = 500, 512
BINS = 1 << 16
TEMPER = 0.25
#: A text must be likelier per trigram than the least likely training text by no less than this.
MARGIN = 3.0
MIN_LETTERS = 4
#: Pseudo-rows by which each level is drawn to the one above it.
STRENGTH = 10.0
UNKNOWN = "und"

HIDDEN = re.compile(r"<(script|style)\b", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
NOT_LETTERS = re.compile(r"[\W\d_]+")
DECLARED = r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]+)"


def visible(html: str | None) -> str:
    """What stands outside of tags, comments, scripts and styles, in one scan: an end that was not found is not looked for again."""
    out, at, html = [], 0, html or ""
    missing: set[str] = set()
    while (tag := html.find("<", at)) >= 0 and (end := html.find(">", tag)) >= 0:
        out.append(html[at:tag])
        at = end + 1
        hidden = HIDDEN.match(html, tag)
        if hidden and (name := hidden[1].lower()) not in missing:
            if close := ENDS[name].search(html, at):
                at = close.end()
            else:
                missing.add(name)
        elif html.startswith("<!--", tag) and "-->" not in missing:
            if (close := html.find("-->", tag + 4)) >= 0:
                at = close + 3
            else:
                missing.add("-->")
    out.append(html[at:])
    return " ".join(out)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased runs of letters, with blanks around each."""
    data = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((data[:-2] * 40503 + data[1:-1] * 2531 + data[2:] * 83) * np.uint32(2654435761) >> np.uint32(16)) & np.uint32(BINS - 1)


@dataclass
class TextModel:
    languages: list[str]
    #: [bin, language] of log probabilities.
    logs: np.ndarray
    floor: float

    def evidence(self, text: str | None) -> np.ndarray | None:
        """Tempered log-likelihoods, or None for a text in none of the languages."""
        if not self.languages or not text or sum(1 for _ in islice(filter(str.isalpha, text), MIN_LETTERS)) < MIN_LETTERS:
            return None
        bins = trigrams(text)
        logs = np.zeros(len(self.languages))
        for at in range(0, len(bins), 1 << 16):
            logs += self.logs[bins[at : at + (1 << 16)]].sum(0)
        if logs.max() / len(bins) < self.floor:
            return None
        return TEMPER * logs


def fit_text(labelled: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", lang_col="lang") -> TextModel:
    """Trigram models of all labelled languages, each from the ``sample`` different rows of least hash."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labelled languages")
    languages = sorted(counts)
    if not languages:
        return TextModel([], np.empty((BINS, 0), np.float32), 0.0)
    # Twice as many rows as are asked for lie below this share of the hashes; few of them are sorted, however large a language.
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 2 * sample / counts[lang]))])
    some = known.where((F.col("h") / 2.0**64 + 0.5 <= share[F.col("lang")])).dropDuplicates(["lang", "h"])
    few = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)

    @F.arrow_udf("array<struct<b:int,n:int>>")
    def bins(texts: pa.Array) -> pa.Array:
        counted = [np.unique(trigrams(t or ""), return_counts=True) for t in texts.to_pylist()]
        return pa.array([[{"b": b, "n": c} for b, c in zip(found.tolist(), n.tolist())] for found, n in counted], pa.list_(pa.struct([("b", pa.int32()), ("n", pa.int32())])))

    # At most bins x languages sums, and as many rows of texts as the sample has.
    texts = scratch.stage(few.select("lang", bins("text").alias("x")), "trigrams")
    table = np.full((BINS, len(languages)), 0.1)
    sums = texts.select("lang", F.explode("x").alias("x")).groupBy("lang", "x.b").agg(F.sum("x.n").alias("n")).toArrow()
    which = {x: i for i, x in enumerate(languages)}
    own = sums.column("lang").combine_chunks().dictionary_encode()
    at = np.asarray([which[x] for x in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()] if len(own) else np.empty(0, np.int64)
    table[sums.column("b").to_numpy(), at] += sums.column("n").to_numpy()
    logs = np.log(table / table.sum(0)).astype(np.float32)

    @F.arrow_udf("double")
    def mean(lang: pa.Array, x: pa.Array) -> pa.Array:
        out = []
        for name, found in zip(lang.to_pylist(), x.to_pylist()):
            b, n = np.asarray([f["b"] for f in found], np.int64), np.asarray([f["n"] for f in found], float)
            out.append(float((logs[b, which[name]] * n).sum() / n.sum()) if n.sum() > 60 else None)
        return pa.array(out, pa.float64())

    low = texts.select(F.min(F.nanvl(mean("lang", "x"), F.lit(None)))).first()[0]
    return TextModel(languages, logs, (low if low is not None else -11.0) - MARGIN)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def attached(rows: DataFrame, key: str, table: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of the ``table`` (key, rows, column), by key.

    Keys with more than a thousandth of all rows, a thousand at most, are
    broadcast; only other rows meet the table by their key.
    """
    table = scratch.stage(table, "table")
    total = table.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(table.where(F.col("rows") * 1000 > total).select(key, F.col(column).alias("hot")))
    rows = rows.join(hot, key, "left")
    spread = F.when(F.col("hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).cast("string")))
    cold = table.where(F.col("rows") * 1000 <= total).select(F.col(key).alias("cold_key"), F.col(column).alias("cold"))
    joined = rows.withColumn("key", spread).join(cold, F.col("key") == F.col("cold_key"), "left")
    return joined.withColumn(column, F.coalesce("hot", "cold")).drop("hot", "cold", "key", "cold_key")


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, keep: Column, markup: bool = False) -> DataFrame:
    """(row, lang, probability, text_lang, accepted): ``keep`` of every row, and its language.

    Texts go through the model once: what it says of them is written with ``keep`` before priors are taken of it.
    """
    n, languages = len(model.languages), model.languages
    if not n:
        none = F.lit(UNKNOWN)
        return rows.select(keep.alias("row"), none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), F.lit(False).alias("accepted"))

    @F.arrow_udf("array<double>")
    def likelihoods(texts: pa.Array) -> pa.Array:
        tokens.forget()
        return pa.array([None if (e := model.evidence(visible(t) if markup else t)) is None else e - e.max() for t in texts.to_pylist()], pa.list_(pa.float64()))

    known = F.when(declared.isin(languages), declared)
    with scratch.bounded_batches(rows.sparkSession):
        scored = scratch.stage(rows.select(keep.alias("row"), F.coalesce(host, F.lit("")).alias("host"), known.alias("declared"), likelihoods(text).alias("ll")), "likelihoods")
    # Text posteriors in millionths: sums of integers come out alike in any order.
    odds = F.transform("ll", lambda x: F.exp(x))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    shares = scored.where("ll is not null").select("host", "declared", F.transform(odds, lambda x: F.round(x / total * 1_000_000).cast("long")).alias("s"))
    sums = [F.sum(F.col("s")[i]).alias(f"n{i}") for i in range(n)]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    hosts = scratch.stage(shares.groupBy("host", "declared").agg(F.count(F.lit(1)).alias("rows"), *sums), "hosts")
    # Languages x languages and one row: both bounded.
    confusion = np.ones((n, n))
    for r in hosts.where("declared is not null").groupBy("declared").agg(*again).collect():
        confusion[languages.index(r.declared)] += [r[f"n{i}"] / 1e6 for i in range(n)]
    everywhere = [(x or 0) / 1e6 for x in hosts.agg(*again).first()]

    by_host = hosts.groupBy("host").agg(F.sum("rows").alias("rows"), *again).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    counts = F.array(*[F.col(f"n{i}") / 1e6 for i in range(n)])
    level = lambda key, name: by_host.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.sum(f"n{i}") / 1e6 for i in range(n)]).alias(name))
    priors = by_host.select("host", "rows", "domain", "suffix", counts.alias("of_host"))
    priors = attached(attached(priors, "domain", level("domain", "of_domain"), "of_domain"), "suffix", level("suffix", "of_suffix"), "of_suffix")
    priors = priors.select("host", "rows", F.struct("of_host", "of_domain", "of_suffix").alias("prior"))

    joined = attached(scored, "host", priors, "prior").withColumn("own", F.transform(odds, lambda x: x / total))
    prior = F.array(*[F.lit(1 / n)] * n)
    for counted in (F.array(*map(F.lit, everywhere)), F.col("prior.of_suffix"), F.col("prior.of_domain"), F.col("prior.of_host")):
        # A row's own share is taken out again.
        joined = joined.withColumn("rest", F.zip_with(counted, "own", lambda a, b: F.greatest(a - b, F.lit(0.0))))
        size = F.aggregate("rest", F.lit(0.0), lambda a, x: a + x) + STRENGTH
        joined = joined.withColumn("p", prior).withColumn("p", F.zip_with("rest", "p", lambda a, b: a + STRENGTH * b)).withColumn("size", size)
        joined, prior = joined.withColumn("p", F.transform("p", lambda x: x / F.col("size"))), F.col("p")
    said = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.array(*map(F.lit, confusion[i].tolist())))])[F.col("declared")]
    in_all = F.array(*map(F.lit, confusion.sum(0).tolist()))
    told = F.zip_with(F.zip_with(said, "own", lambda a, b: a - b), F.zip_with(in_all, "own", lambda a, b: a - b), lambda a, b: F.log(F.greatest(a, F.lit(1e-9)) / b))
    logs = F.zip_with(F.zip_with("ll", "p", lambda a, b: a + F.log(b)), F.coalesce(told, F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    joined = joined.withColumn("logs", logs)
    top = F.array_max("logs")
    joined = joined.withColumns({"best": F.array_position("logs", top).cast("int"), "text_best": F.array_position("ll", F.array_max("ll")).cast("int")})
    joined = joined.withColumn("probability", 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))), F.lit(0.0), lambda a, x: a + x))
    names, sure = F.array(*map(F.lit, languages)), F.coalesce(F.col("probability") > 0.5, F.lit(False))
    return joined.select(
        "row", F.when(sure, F.element_at(names, F.col("best"))).otherwise(UNKNOWN).alias("lang"), F.coalesce(F.round("probability", 6), F.lit(0.0)).alias("probability"),
        F.when(F.col("ll").isNotNull(), F.element_at(names, F.col("text_best"))).otherwise(UNKNOWN).alias("text_lang"), sure.alias("accepted"),
    )


def identify_pages(pages: DataFrame, labelled: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Per page: lang, probability, text_lang (by text alone) and accepted."""
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), DECLARED, 1))
    found = identify(pages, fit_text(labelled), F.col(html_col), declared, host_of(F.col(url_col)), F.col(id_col), markup=True)
    return found.withColumnRenamed("row", "page_id")


def keep_identified(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The documents whose language is told by text and source, with their columns.

    Sources stand for hosts.  The labels fit the text model and are no evidence of their own row besides.
    What is told depends on text and source alone: only two 64-bit hashes of them are written beside the likelihoods.
    """
    key = ["h1", "h2"]
    hashes = [F.xxhash64(*x, F.col(text_col), F.lit(0), F.col(source_col)).alias(h) for h, x in zip(key, ([], [F.lit(1)]))]  # a null leaves a hash as it is
    found = identify(docs, fit_text(docs, text_col=text_col, lang_col=lang_col), F.col(text_col), F.lit(None).cast("string"), F.col(source_col), F.struct(*hashes))
    untold = scratch.stage(found.where("not coalesce(accepted, false)").select("row.*").distinct(), "untold")
    return without(docs.select(F.struct("*").alias("row"), *hashes), untold, key).select("row.*")
