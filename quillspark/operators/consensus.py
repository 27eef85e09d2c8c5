"""Consensus of repeated noisy extractions: greedy clusters, mode, medoid, confidence.

Clustering depends on order (a line joins the first cluster whose first member
is similar enough), so each page is one ordered group in Python.  Similarity is
difflib's ratio of the lower-cased texts.  Pages may be long: equal texts are
met once, and pairs whose lengths, letter counts, common trigrams or longest
common subsequence already bound the ratio by 0.8 are never aligned.  None
changes a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILAR = 0.8


def ratio(a: str, b: str) -> float:
    a, b = a.lower(), b.lower()
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lines:
    """Lower-cased texts, and which earlier ones a text may be similar to.

    Matching blocks take no more letters than both texts have in common.  A
    block of m letters has m - 2 trigrams, so k blocks take at most the common
    trigrams and 2 k letters more.  In a text of 200 letters or more difflib
    passes over letters that are popular there: each block holds an unpopular
    letter of it, but for one at the very beginning, which bounds k.  At last,
    blocks form a common subsequence.
    """

    #: Counters of letters where a page has more kinds of them, and of trigrams; some may share one, which keeps the bounds.
    LETTERS, TRIGRAMS, BLOCK = 512, 512, 1024

    def __init__(self, texts: list[str]):
        self.texts = [t.lower() for t in texts]
        self.sizes = np.asarray([len(t) for t in self.texts], np.int64)
        letters = codes("".join(self.texts))
        kinds = int(letters.max(initial=0)) + 1
        exact = kinds <= 256
        if not exact:
            found, letters = np.unique(letters, return_inverse=True)
            kinds = len(found)
            exact = kinds <= self.LETTERS
            letters = letters if exact else letters % self.LETTERS
        kinds = min(kinds, self.LETTERS)
        kind = np.uint16 if self.sizes.max(initial=0) < 1 << 16 else np.uint32
        ends = np.cumsum(self.sizes)
        blocks = []
        for first in range(0, len(texts), self.BLOCK):
            sizes = self.sizes[first : first + self.BLOCK]
            n, at = len(sizes), int(ends[first] - sizes[0])
            own, line = letters[at : at + int(sizes.sum())].astype(np.int64), np.repeat(np.arange(n), sizes)
            counts = np.bincount(line * kinds + own, minlength=n * kinds).reshape(n, kinds)
            whole = line[2:] == line[:-2]
            three = ((own[:-2] * 961 + own[1:-1] * 31 + own[2:]) % self.TRIGRAMS)[whole]
            trigrams = np.bincount(line[2:][whole] * self.TRIGRAMS + three, minlength=n * self.TRIGRAMS).reshape(n, -1)
            rare = np.where(counts > (sizes // 100 + 1)[:, None], 0, counts) if exact else counts
            blocks.append([x.astype(kind) for x in (counts, trigrams, rare)])
        self.counts, self.trigrams, self.rare = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*blocks)) if blocks else ((),) * 3
        self.masks: dict[int, dict[str, int]] = {}

    def mask(self, i: int) -> dict[str, int]:
        """For each letter of a text, the bits of its places."""
        if i not in self.masks:
            low, found = codes(self.texts[i]), {}
            if len(low) < 400:
                for at, c in enumerate(self.texts[i]):
                    found[c] = found.get(c, 0) | 1 << at
            else:
                for c in np.unique(low).tolist():
                    found[chr(c)] = int.from_bytes(np.packbits(low == c, bitorder="little").tobytes(), "little")
            self.masks[i] = found
        return self.masks[i]

    def near(self, i: int, leaders: np.ndarray) -> list[int]:
        """Of the leaders (in order) those that text i may be similar to."""
        size = int(self.sizes[i])
        if not size:
            return leaders[self.sizes[leaders] == 0].tolist()
        sizes = self.sizes[leaders]
        total = sizes + size
        few = np.flatnonzero(2.0 * np.minimum(sizes, size) / total > SIMILAR)
        if not len(few):
            return []
        leaders, sizes, total = leaders[few], sizes[few], total[few]
        most = np.minimum(self.counts[leaders], self.counts[i]).sum(1, dtype=np.int64)
        few = np.flatnonzero(2.0 * most / total > SIMILAR)
        if not len(few):
            return []
        leaders, sizes, total, most = leaders[few], sizes[few], total[few], most[few]
        if (long := sizes >= 200).any():
            common = np.minimum(self.trigrams[leaders], self.trigrams[i]).sum(1, dtype=np.int64)
            seeds = np.minimum(self.rare[leaders], self.counts[i]).sum(1, dtype=np.int64)
            most = np.where(long, np.minimum(most, common + 2 * (seeds + 1)), most)
            leaders = leaders[2.0 * most / total > SIMILAR]
        return self.in_line(i, leaders.tolist())

    def in_line(self, i: int, leaders: list[int]) -> list[int]:
        """Those whose longest common subsequence with text i is long enough: bit-parallel steps over the text, the leaders side by side with a bit between."""
        if not leaders:
            return []
        where: dict[str, int] = {}
        bits, end, starts = 0, 0, []
        for j in leaders:
            for c, at in self.mask(j).items():
                where[c] = where.get(c, 0) | at << end
            starts.append(end)
            n = len(self.texts[j])
            bits |= ((1 << n) - 1) << end
            end += n + 1
        v = bits
        for c in self.texts[i]:
            if u := v & where.get(c, 0):
                v = ((v + u) | (v - u)) & bits
        missed, size = bits & ~v, len(self.texts[i])
        return [j for j, at in zip(leaders, starts) if 2.0 * (missed >> at & ((1 << len(self.texts[j])) - 1)).bit_count() / (len(self.texts[j]) + size) > SIMILAR]


def first_clusters(texts: list[str]) -> list[int]:
    """Of each text the number of the first cluster whose first text is similar, or of its own new one.

    A text met again joins the same cluster: those before it are as they were.
    """
    distinct = list(dict.fromkeys(texts))
    if len(distinct) == 1:
        return [0] * len(texts)
    lines, known = Lines(distinct), {}
    leaders, n = np.empty(len(distinct), np.int64), 0
    number: dict[int, int] = {}
    for i, t in enumerate(distinct):
        first = next((j for j in lines.near(i, leaders[:n]) if ratio(t, distinct[j]) > SIMILAR), i) if n else i
        if first == i:
            leaders[n], number[i], n = i, n, n + 1
        known[t] = number[first]
    return [known[t] for t in texts]


def medoid(texts: list[str]) -> str:
    """The text of highest mean similarity to all; the first of equals."""
    distinct = list(dict.fromkeys(texts))
    if len(distinct) == 1:
        return distinct[0]
    at = {t: i for i, t in enumerate(distinct)}
    order = np.asarray([at[t] for t in texts])
    means = [sum(np.asarray([ratio(t, x) for x in distinct])[order].tolist()) / len(texts) for t in distinct]
    return distinct[max(range(len(distinct)), key=lambda i: (means[i], -i))]


def merge_takes(rows: list[tuple[int, int, str, str, float]], takes: int) -> list[tuple]:
    """Consensus lines of (take, position, character, text, confidence): character, text, confidence, match_confidence, members."""
    rows = sorted(rows)
    clusters: dict[int, list[tuple]] = {}
    for row, i in zip(rows, first_clusters([r[3] for r in rows])):
        clusters.setdefault(i, []).append(row)
    out = []
    for c in sorted(clusters.values(), key=lambda c: sum([r[1] for r in c]) / len(c)):
        characters = [r[2] for r in c]
        character = characters[0]
        n = characters.count(character)
        if 2 * n < len(c):
            character, n = Counter(characters).most_common(1)[0]
        match = n / takes
        mean = sum([r[4] for r in c]) / len(c)
        confidence = 1.0 if len(c) == 1 and takes == 1 else 0.6 * match + 0.4 * mean
        out.append((character, medoid([r[3] for r in c]), confidence, match, len(c)))
    return out


def consensus(takes: DataFrame, page: str = "page") -> DataFrame:
    """One row a consensus line of each page: page, pos, character, text, confidence, match_confidence, members.

    Pages come one after another and are merged as they end, without a table each.
    """
    columns = ["take", "pos", "character", "text", "confidence"]
    names = [page, "pos", "character", "text", "confidence", "match_confidence", "members"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def end() -> None:
            if rows:
                out.extend((key, i, *x) for i, x in enumerate(merge_takes(rows, len({r[0] for r in rows}))))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for given in batches:
            pages = given.column(0).to_pylist()
            for k, row in zip(pages, zip(*(c.to_pylist() for c in given.columns[1:]))):
                if k != key:
                    end()
                    key, rows = k, []
                rows.append(row)
            if out:
                yield batch()
                out = []
        end()
        if out:
            yield batch()

    ordered = takes.select(page, *columns).repartition(page).sortWithinPartitions(page)
    return ordered.mapInArrow(merge, f"{page} long, pos long, character string, text string, confidence double, match_confidence double, members long")


def similarity(a: Column, b: Column) -> Column:
    """difflib's ratio of two columns (STR07)."""

    @F.pandas_udf("double")
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y)], dtype=float)

    return ratios(a, b)


def normalized_confidence(probability: Column, highest: Column) -> Column:
    """Probability over the highest one (PRJ24)."""
    return probability / highest


def with_reviews(pages: DataFrame, reviews: DataFrame, key: str = "page") -> DataFrame:
    """Reviewed lines replace a page's; an empty review deletes the page; reviewed confidence is 1.0 (JON07, JON08)."""
    joined = pages.join(reviews.select(key, F.col("lines").alias("__new")), key, "left")
    return (
        joined.where(F.col("__new").isNull() | (F.size("__new") > 0))
        .withColumns({"lines": F.coalesce("__new", "lines"), "confidence": F.when(F.col("__new").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence"))}).drop("__new")
    )
