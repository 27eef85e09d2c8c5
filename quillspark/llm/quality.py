"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.  The
counts of their vote patterns over all documents (at most 3 ** labellers of
them) go to an expectation-maximisation that estimates each labeller's
accuracies and the posterior of every pattern.  The posteriors of a bounded
sample of texts then train a logistic scorer on hashed token shapes, which
decides for every document from its whole text.

Defined results: a null or empty text gets no votes and the scorer's prior.
Repeated rows get equal results; a text of any length is judged whole; scores
that tie with the threshold are kept.  An empty table gives an empty result.
Columns of the input may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens
from .keyfilter import without

#: Rows that train the scorer; those of least id hash.
SAMPLE = 6000
#: Size of the hashed feature space, as a power of two.
BITS = 14
KEEP_FROM = 0.5
#: Letters of the longest word that a worker keeps the shape of, and words from which on it forgets them.
LONGEST_KEPT, MOST_KEPT = 64, 60_000

# Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    """the of and to in a is that for it with as was on be by this are or an from at
    le la les de des du et un une en que est pour dans sur au par qui
    der die das und ist von den mit zu ein eine nicht im auf als
    el los las y que del se por con una para no su lo""".split()
)
LABELLERS = ("symbols", "capitals", "exclamations", "stutter", "variety", "top_word", "table", "function_words", "sentences")


def between(x: float, low: float, high: float) -> int:
    """Good at or under ``low``, bad over ``high``, else nothing."""
    return 1 if x <= low else -1 if x > high else 0


#: The function words in all mixtures of capitals; no other letters become those of a function word in lower case.
FORMS = frozenset("".join(x) for w in FUNCTION_WORDS for x in product(*((c, c.upper()) for c in w)))
EDGES = frozenset(".,!?")
ODD = re.compile(r"[#%&*$|~^=<>{}\[\]@_\\]\S*")
END = re.compile(r"[.!?](?!\S)")
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + CAPITALS.lower()
ASCII = bytes(range(128))


def letters(text: str) -> tuple[int, int]:
    """Letters of a text, and capitals."""
    raw = text.encode("utf-8", "surrogatepass")
    found, capitals = (len(raw) - len(raw.translate(None, some)) for some in (LETTERS, CAPITALS))
    if len(raw) > len(text):
        rest = Counter(raw.translate(None, ASCII).decode("utf-8", "surrogatepass"))
        found += sum(c for x, c in rest.items() if x.isalpha())
        capitals += sum(c for x, c in rest.items() if x.isupper())
    return found, capitals


def split(text: str | None) -> tuple[list[str], int]:
    """The words of a text, and how many equal the one before."""
    words = text.split() if text else []
    return words, sum(map(eq, words, words[1:]))


def votes(text: str | None) -> tuple[int, ...]:
    """1 good, -1 bad, 0 nothing, for each labeller."""
    return votes_of(text, *split(text))


def votes_of(text: str | None, words: list[str], same: int) -> tuple[int, ...]:
    """The votes on a text that is split already."""
    n = len(words)
    if n < 3:
        return (0,) * len(LABELLERS)
    alphabetic, capitals = letters(text)
    counts = Counter(words)
    plain = sum(counts[w] for w in counts.keys() & FORMS)
    plain += sum(counts[w] for w in [w for w in counts if w[-1] in EDGES or w[0] in EDGES] if w.lower().strip(".,!?") in FUNCTION_WORDS)
    plain, ends = plain / n, len(END.findall(text))
    blocks = [len(set(words[i : i + 50])) / 50 for i in range(0, n - 49, 50)]
    return (
        between(len(ODD.findall(text)) / n, 0.02, 0.15),
        between(capitals / (alphabetic or 1), 0.15, 0.4),
        between(text.count("!!") / n, 0.0, 0.1),
        between(same / n, 0.05, 0.2),
        between(1 - sum(blocks) / len(blocks), 0.45, 0.6) if blocks else 0,
        between(max(counts.values()) / n, 0.15, 0.25) if n >= 20 else 0,
        between(counts.get("|", 0) / n, 0.0, 0.1),
        # Prose of another script has none of these words, which says nothing.
        (1 if plain >= 0.1 else -1 if plain < 0.02 and len(text.encode("ascii", "ignore")) > 0.7 * len(text) else 0) if n >= 20 else 0,
        between(n / max(ends, 1), 60, 100) if n >= 30 else 0,
    )


def pattern(v: tuple[int, ...]) -> str:
    return "".join("-0+"[x + 1] for x in v)


@dataclass
class LabelModel:
    """Accuracies of the labellers and the share of good documents, by expectation-maximisation."""

    good: float = 0.8
    #: [labeller, class (bad, good), vote (bad, nothing, good)]; no vote is no evidence.
    tables: np.ndarray = field(default_factory=lambda: np.empty(0))

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables)
        both = [sum(logs[j, c, patterns[:, j]] for j in range(patterns.shape[1])) for c in (0, 1)]
        return both[1] - both[0] + np.log(self.good / (1 - self.good))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -50, 50)))

    @classmethod
    def fit(cls, counts: dict[str, int], rounds: int = 40) -> LabelModel:
        seen = np.asarray([["-0+".index(c) for c in p] for p in counts] or np.empty((0, len(LABELLERS))), np.int64).reshape(-1, len(LABELLERS))
        weight = np.asarray(list(counts.values()), float)
        net = (seen - 1).sum(1)
        post = np.where(net > 0, 0.9, np.where(net < 0, 0.1, 0.5))
        # A labeller that says bad marks the rarer class: begin where any two agree on it.
        post = np.where((seen == 0).sum(1) >= 2, np.minimum(post, 0.2), post)
        model = cls()
        for _ in range(rounds):
            both = np.stack([weight * (1 - post), weight * post])
            tables = np.ones((len(LABELLERS), 2, 3))
            for j in range(len(LABELLERS)):
                for v in (0, 2):
                    tables[j, :, v] += both[:, seen[:, j] == v].sum(1)
            model.tables = tables / (tables[:, :, :1] + tables[:, :, 2:])
            model.tables[:, :, 1] = 1.0
            model.good = float((both[1].sum() + 1) / (weight.sum() + 2))
            post = model.posterior(seen)
        return model


SHAPE = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)


def shape(word: str) -> str:
    """Runs of letters as a, A or Aa, of digits as 0, of another character as one or two of it."""

    def run(m: re.Match) -> str:
        s = m[0]
        if m[1] is not None and not s[0].isalnum():
            return s[:2]
        return "0" if s[0].isdigit() else "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa"

    return SHAPE.sub(run, word)[:12]


class Known(dict):
    """Checksums of the shapes of words."""

    def __missing__(self, word: str) -> int:
        # Letters alone, and letters before one mark, are told without the pattern.
        body, last = word[:-1], word[-1]
        if word.isalpha():
            like = "a" if word.islower() else "A" if word.isupper() and body else "Aa"
        elif body.isalpha() and not last.isalnum():
            like = ("a" if body.islower() else "A" if body.isupper() and len(body) > 1 else "Aa") + last
        else:
            like = shape(word)
        self[word] = found = zlib.crc32(like.encode("utf-8", "surrogatepass"))
        return found


class Shapes:
    """Hashed features of a text: counts of shapes, of shape pairs and of repeated words, by length.

    A few words more are counted in the length, so that very short texts say little.
    """

    def __init__(self):
        self.known = Known()

    def places(self, words: list[str]) -> np.ndarray:
        """The feature of each word, then of each two that stand side by side."""
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        # Words of a text are kept together, however long; what stays for other texts is bounded.
        if len(self.known) > MOST_KEPT or len(max(words, key=len)) > LONGEST_KEPT:
            self.known.clear()
        return np.concatenate([ids, ids[:-1] * 31 + ids[1:] * 17 + 7]) & (1 << BITS) - 1

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words, same = split(text)
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        found, counts = np.unique(self.places(words), return_counts=True)
        size = len(words) + 4
        return np.append(found, 1 << BITS), np.append(counts / size, 2.0 * same / size)


@lru_cache(maxsize=1)
def worker_shapes() -> Shapes:
    """One cache of shapes a worker."""
    return Shapes()


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer, by full-batch gradient steps with momentum."""
    size = (1 << BITS) + 2
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    cols = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
    vals = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    w, speed = np.zeros(size), np.zeros(size)
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(at, vals * w[cols], len(rows)) + w[-1]
        miss = 1 / (1 + np.exp(-z)) - target
        grad = np.bincount(cols, vals * miss[at], size) / len(rows) + ridge * w
        grad[-1] = miss.mean()
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        """The linear scorer's probability."""
        return self.score_of(*split(text))

    def score_of(self, words: list[str], same: int) -> float:
        """The score of a text that is split already: equal features need not be counted, as their weights are summed."""
        odds = float(self.weights[-1])
        if words:
            odds += float(self.weights[worker_shapes().places(words)].sum() + 2.0 * same * self.weights[1 << BITS]) / (len(words) + 4)
        return round(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))), 6)

    def judged(self, rows: DataFrame, id_type: str) -> DataFrame:
        """(doc_id, pattern, posterior, score, keep) of rows (doc_id, text)."""
        model = self

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                seen, score = [], []
                for text in texts:
                    words, same = split(text)
                    seen.append(votes_of(text, words, same))
                    score.append(model.score_of(words, same))
                posterior = np.round(model.labels.posterior(np.asarray(seen, np.int64).reshape(-1, len(LABELLERS)) + 1), 6)
                score = np.asarray(score, float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([pattern(v) for v in seen], pa.string()), pa.array(posterior, pa.float64()), pa.array(score), pa.array(score >= KEEP_FROM)],
                    ["doc_id", "pattern", "posterior", "score", "keep"],
                )

        return rows.mapInArrow(judge, f"doc_id {id_type}, pattern string, posterior double, score double, keep boolean")

    def rejected(self, rows: DataFrame) -> DataFrame:
        """(h1, h2) of rows (h1, h2, text) that the scorer doesn't keep; no votes are taken."""
        model = self

        def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            for batch in batches:
                bad = pa.array([model.score(t) < KEEP_FROM for t in batch.column(2).to_pylist()], pa.bool_())
                yield batch.select([0, 1]).filter(bad)

        return rows.mapInArrow(reject, "h1 long, h2 long")


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Label model from the votes on all documents; scorer from the posteriors of ``sample`` of them, the texts of least hash."""
    docs = docs.select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in batch.column(0).to_pylist()], pa.string())], ["p"])

    with scratch.bounded_batches(docs.sparkSession):
        counts = {r[0]: r[1] for r in docs.select("text").mapInArrow(voted, "p string").groupBy("p").count().collect()}
    labels = LabelModel.fit(counts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [worker_shapes().of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pattern(votes(t)) for t in texts], pa.string()), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
                ["h", "pattern", "cols", "vals"],
            )

    # Repeated rows share a hash: of them one is in the sample.
    some = docs.where("text is not null")
    bound = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = []
    if bound is not None:
        chosen = scratch.stage(some.where(F.col("h") <= bound).dropDuplicates(["h"]), "sample")
        with scratch.bounded_batches(docs.sparkSession):
            rows = chosen.select("h", "text").mapInArrow(features, "h long, pattern string, cols array<long>, vals array<double>").orderBy("h").collect()
    seen = np.asarray([["-0+".index(c) for c in r["pattern"]] for r in rows], np.int64).reshape(-1, len(LABELLERS))
    target = labels.posterior(seen) if len(rows) else np.empty(0)
    return QualityModel(labels, train([(np.asarray(r["cols"], np.int64), np.asarray(r["vals"])) for r in rows], target))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: vote pattern, posterior of the label model, score and decision of the scorer."""
    model, rows = fit(docs, id_col=id_col, text_col=text_col), docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch.bounded_batches(docs.sparkSession):
        return scratch.stage(model.judged(rows, rows.schema["doc_id"].dataType.simpleString()), "judged")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the scorer keeps, with their columns.

    What it says depends on the text alone: rejected texts are written by two
    64-bit hashes, and the documents pass by those without going through Python.
    """
    model, key = fit(docs, id_col=id_col, text_col=text_col), ["h1", "h2"]
    hashes = [F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2")]
    with scratch.bounded_batches(docs.sparkSession):
        bad = scratch.stage(model.rejected(docs.select(*hashes, F.col(text_col).alias("text"))), "rejected")
    return without(docs.select(F.struct("*").alias("row"), *hashes), scratch.stage(bad.distinct(), "rejected"), key).select("row.*")
