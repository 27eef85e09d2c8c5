"""The two classifiers and the pipeline, against plain Python on whole small tables."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language, packing, quality, queries, scratch

from .test_operators import brute_components, brute_leaks

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_quality_held_out_accuracy(spark):
    found = queries.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = [r.keep == (r.quality == 1) for r in found]
    assert np.mean(right) > 0.97
    assert np.mean([r.keep for r in found if r.quality == 1]) > 0.99  # clean documents stay


def plain_votes(text):
    """The labellers, written from their description."""
    words = (text or "").split()
    n, counts = len(words), Counter(words)
    if n < 3:
        return [0] * 9

    def told(share, low, high):
        return 1 if share <= low else -1 if share > high else 0

    letters = max(1, len([c for c in text if c.isalpha()]))
    blocks = [Counter(words[i : i + 50]) for i in range(0, n, 50) if i + 50 <= n]
    common = sum(c for w, c in counts.items() if w.lower().strip(".,!?") in quality.FUNCTION_WORDS) / n
    latin = len([c for c in text if ord(c) < 128]) > 0.7 * len(text)
    out = [
        told(len([w for w in words if re.search(r"[#%&*$|~^=<>{}\[\]@_\\]", w)]) / n, 0.02, 0.15),
        told(len([c for c in text if c.isupper()]) / letters, 0.15, 0.4),
        told(len(re.findall("!!", text)) / n, 0, 0.1),
        told(sum(words[i] == words[i - 1] for i in range(1, n)) / n, 0.05, 0.2),
        told(1 - np.mean([len(b) / 50 for b in blocks]), 0.45, 0.6) if blocks else 0,
        told(counts.most_common(1)[0][1] / n, 0.15, 0.25) if n >= 20 else 0,
        told(counts["|"] / n, 0, 0.1),
        (1 if common >= 0.1 else -1 if common < 0.02 and latin else 0) if n >= 20 else 0,
        told(n / max(1, len([w for w in words if w.endswith((".", "!", "?"))])), 60, 100) if n >= 30 else 0,
    ]
    return out


def plain_posteriors(seen, rounds=40):
    """Expectation-maximisation row by row instead of by pattern."""
    post = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in seen]
    post = [min(p, 0.2) if v.count(-1) >= 2 else p for p, v in zip(post, seen)]
    for _ in range(rounds):
        good = (sum(post) + 1) / (len(post) + 2)
        rate = {}
        for j in range(9):
            for c in (0, 1):
                share = [p if c else 1 - p for p in post]
                up, down = (1 + sum(s for s, v in zip(share, seen) if v[j] == x) for x in (1, -1))
                rate[j, c, 1], rate[j, c, -1], rate[j, c, 0] = up / (up + down), down / (up + down), 1.0
        odds = [math.log(good / (1 - good)) + sum(math.log(rate[j, 1, v[j]] / rate[j, 0, v[j]]) for j in range(9)) for v in seen]
        post = [1 / (1 + math.exp(-max(-50, min(50, z)))) for z in odds]
    return post


def plain_score(text, weights):
    """The linear scorer over a dictionary of features."""
    words = (text or "").split()
    if not words:
        return 1 / (1 + math.exp(-weights[-1]))
    size, ids = len(words) + 4, [zlib.crc32(quality.shape(w).encode("utf-8", "surrogatepass")) for w in words]
    x = defaultdict(float)
    for i in ids:
        x[i % 2**quality.BITS] += 1 / size
    for i, j in zip(ids, ids[1:]):
        x[(31 * i + 17 * j + 7) % 2**quality.BITS] += 1 / size
    x[2**quality.BITS] = 2 * sum(a == b for a, b in zip(words, words[1:])) / size
    return 1 / (1 + math.exp(-sum(v * weights[k] for k, v in x.items()) - weights[-1]))


def test_quality_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (7, "", "en", "s", 0)], docs.schema))
    texts = [r.text for r in rows] + [r.text for r in rows if r.doc_id < 5] + [None, ""]
    seen = [plain_votes(t) for t in texts]
    want = defaultdict(list)
    model = quality.fit(docs)
    for t, v, p in zip(texts, seen, plain_posteriors(seen)):
        want[t].append(("".join({1: "+", 0: "0", -1: "-"}[x] for x in v), p, plain_score(t, model.weights)))
    got = quality.classify(docs).collect()
    text_of = {r.doc_id: {r.text} for r in rows} | {None: {None}}
    text_of[7].add("")
    assert len(got) == len(texts)
    for r in got:
        assert any(r.pattern == p and r.posterior == pytest.approx(q, abs=1e-5) and r.score == pytest.approx(s, abs=1e-5) for t in text_of[r.doc_id] for p, q, s in want[t])
        assert r.keep == (r.score >= quality.KEEP_FROM)


def test_words_of_letters_need_no_pattern(monkeypatch):
    words = "Plain words, of LETTERS. É Éa! ÉÀ ªb² ²a a² a_ a- x2 a.b -- 漢字。 Ǆx e\u0301 A, .".split()
    told, met = [zlib.crc32(quality.shape(w).encode()) for w in words], []
    pattern = quality.shape
    monkeypatch.setattr(quality, "shape", lambda w: met.append(w) or pattern(w))
    mask = (1 << quality.BITS) - 1
    found, counts = quality.Shapes().of(" ".join(words))
    seen = Counter(n & mask for n in told) + Counter((a * 31 + b * 17 + 7) & mask for a, b in zip(told, told[1:]))
    assert dict(zip(found[:-1].tolist(), np.round(counts[:-1] * (len(words) + 4)).tolist())) == seen
    assert met == ["ªb²", "²a", "a²", "x2", "a.b", "--", "."]


def test_votes_of_mixed_texts():
    texts = ["THE the! of, ..de!! x #a a#b#c é É\x1c漢字. " * 9, "\ud800 a. b ²", "oF,the the.of | | | x" * 30, " ".join("Aa b. C!! d".split() * 40)]
    assert [list(quality.votes(t)) for t in texts] == [plain_votes(t) for t in texts]


def test_prose_of_another_script_is_not_bad_for_it():
    russian = "Мы шли по дороге и видели лес, поле и реку. " * 5
    assert quality.votes(russian)[quality.LABELLERS.index("function_words")] == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    sure = np.linspace(0.6, 0.95, len(quality.LABELLERS))
    counts: dict[str, int] = {}
    for t in truth:
        v = tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < p) == t else -1) for p in sure)
        counts[quality.pattern(v)] = counts.get(quality.pattern(v), 0) + 1
    model = quality.LabelModel.fit(counts, 100)
    assert abs(model.good - 0.7) < 0.05
    assert np.abs(model.tables[:, 1, 2] - sure).max() < 0.06 and np.abs(model.tables[:, 0, 0] - sure).max() < 0.06


def test_quality_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "ok", "x"), (None, "The one of the many.", "x"), (5, "a " * 50_000, "x")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, pattern string, __quality int, keep string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert quality.classify(docs).count() == 5
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.classify(docs.limit(0)).collect() == []
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


MARKUP = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def plain_bins(text):
    kept = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower())
    data = f" {' '.join(kept.split())} ".encode()
    if not data.strip():
        data = b"   "
    return [((a * 40503 + b * 2531 + c * 83) * 2654435761 % 2**32 >> 16) % 2**16 for a, b, c in zip(data, data[1:], data[2:])]


def brute_languages(known, rows, markup=False):
    """known: (text, lang), all of them in the sample; rows: (id, text, declared, host) -> (id, lang, probability, text_lang, accepted)."""
    langs = sorted({lang for _, lang in known if lang})
    counts = {lang: Counter() for lang in langs}
    sample = [(plain_bins(t or ""), lang) for t, lang in set(known) if lang]
    for bins, lang in sample:
        counts[lang].update(bins)
    total = {lang: sum(counts[lang].values()) + 0.1 * 2**16 for lang in langs}
    log = lambda b, lang: math.log((counts[lang][b] + 0.1) / total[lang])
    means = [np.mean([log(b, lang) for b in bins]) for bins, lang in sample if len(bins) > 60]
    floor = min(means, default=-11.0) - 3.0
    scored = []
    for i, t, d, h in rows:
        t = MARKUP.sub(" ", t or "") if markup else t or ""
        e = None
        if sum(c.isalpha() for c in t) >= 4:
            bins = plain_bins(t)
            sums = np.array([sum(log(b, lang) for b in bins) for lang in langs])
            e = 0.25 * sums if sums.max() / len(bins) >= floor else None
        scored.append((i, e, d if d in langs else None, h or ""))
    keys = lambda h: [(), ("s", h.split(".")[-1]), ("d", ".".join(h.split(".")[-2:])), ("h", h)]
    levels, said, own = defaultdict(float), {d: np.ones(len(langs)) for d in langs}, {}
    for k, (_, e, d, h) in enumerate(scored):
        if e is not None:
            own[k] = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            for key in keys(h):
                levels[key] = levels[key] + own[k]
            if d:
                said[d] = said[d] + own[k]
    out = []
    for k, (i, e, d, h) in enumerate(scored):
        if e is None:
            out.append((i, "und", 0.0, "und", False))
            continue
        prior = np.full(len(langs), 1 / len(langs))
        for key in keys(h):
            rest = np.maximum(levels[key] - own[k], 0)
            prior = (rest + 10 * prior) / (rest.sum() + 10)
        z = e + np.log(prior)
        if d:
            z = z + np.log((said[d] - own[k]) / (sum(said.values()) - own[k]))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        sure = bool(p.max() > 0.5)
        out.append((i, langs[int(p.argmax())] if sure else "und", float(p.max()), langs[int(e.argmax())], sure))
    return out


def test_language_against_plain_python(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id < 3"))  # repeated rows
    rows = pages.select("page_id", "html", F.lower(F.regexp_extract("html", language.DECLARED, 1)), language.host_of(F.col("url"))).collect()
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    labelled = [(r.text, r.lang) for r in known.select("text", "lang").collect()]
    assert max(Counter(lang for _, lang in labelled).values()) <= language.SAMPLE
    want = {r[0]: r[1:] for r in brute_languages(labelled, [tuple(r) for r in rows], True)}
    got = language.identify_pages(pages, known).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, p, text_lang, accepted = want[r.page_id]
        assert (r.lang, r.text_lang, r.accepted) == (lang, text_lang, accepted) and r.probability == pytest.approx(p, abs=2e-3)


def test_language_accuracy(spark):
    got = {r.page_id: r.lang for r in queries.op6_language_id(spark, SF).collect()}
    truth = dict(duckdb.sql(f"select page_id, regexp_extract(url, 'example\\.\\w+/(\\w+)/', 1) from '{SF}/pages.parquet'").fetchall())
    assert np.mean([truth[i] == v for i, v in got.items()]) > 0.97


def test_markup_is_scanned_once():
    for html in ("a<b>c<script x>no<p></SCRIPT >d<!-- x > y -->e<style>f", "x < y > z <", "<!--a", "<!-->b-->c", "a<scripts>b</script>c", "<style>a</script>b</style>c<style>d"):
        assert language.visible(html).split() == MARKUP.sub(" ", html).split()
    for part in ("<script>", "<!-- ", "<script", "<style></style ", "<"):
        start = time.perf_counter()
        language.visible(part * (1_000_000 // len(part)))
        assert time.perf_counter() - start < 2


def test_more_than_32_languages(spark):
    rows = [(i, f"q{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 30 + str(i), f"l{k:02}", "s") for i, k in enumerate([*range(40)] * 4)]
    found = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert found.count() == len(rows)


def test_language_edges(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(1, None, None, "x"), (2, "http://a.b/", "", "x"), (3, "odd", "<html lang=fr><p>1234 !!!</p>", "x"), (None, "http://a.b/", "<html lang='en'>the of and thing the of", "x"), (5, "http://h.b/c", "word " * 50_000, "x")]
    pages = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, lang string, host string")
    got = {r.page_id: r.lang for r in language.identify_pages(pages, known).collect()}
    assert len(got) == 5 and got[1] == got[2] == got[3] == "und" and got[None] == "en"
    assert language.identify_pages(pages.limit(0), known).collect() == []
    assert {r.lang for r in language.identify_pages(pages, known.limit(0)).collect()} == {"und"}
    odd = known.withColumns({c: F.lit(1) for c in ("__host", "__declared", "__language", "row", "ll", "p", "prior")})
    assert language.keep_identified(odd).columns == odd.columns


def test_letters_are_sought_in_the_whole_text():
    model = language.TextModel(["en"], np.full((language.BINS, 1), -1.0, np.float32), -10.0)
    assert model.evidence("1 " * 40_000 + "the of and thing") is not None
    assert model.evidence("1 " * 40_000 + "the") is None


def test_pipeline(spark, tmp_path):
    """Whole small tables with nulls, repeats, a very long text and columns of clashing names."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    some = [tuple(r) for r in docs.limit(3).collect()]
    words = some[0][1].split()
    odd = [(None, some[1][1], "en", "s"), (9001, None, None, None), (9002, "", "en", ""), some[2], some[2], (9003, " ".join(words[: len(words) // 2] * 40), some[0][2], "s"), (some[0][0], some[1][1] + " End of it.", some[1][2], "s")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clashing = ("row", "keep", "__row", "__gone", "__host", "__quality", "__language", "th", "id", "maybe", "text_hash", "part", "lang_", "ll")
    docs = docs.withColumns({c: F.lit("x") for c in clashing})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.stage(stage(spark, docs, str(tmp_path)), "s")
        assert sorted(docs.columns) == sorted(("doc_id", "text", "lang", "source", *clashing)), name
        stages.append(docs)
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = quality.fit(whole).weights
    take = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    by_text = lambda rows: sorted(rows, key=repr)
    want = [r for r in take(whole) if plain_score(r[1], weights) >= quality.KEEP_FROM]
    assert by_text(want) == by_text(take(stages[0]))
    told = brute_languages([(t, d) for _, t, d, _ in want], [(k, t, None, h) for k, (_, t, _, h) in enumerate(want)])
    want = [r for r, v in zip(want, told) if v[4]]
    assert by_text(want) == by_text(take(stages[1]))
    root = {k: c for k, _, c in brute_components([(k, r[1]) for k, r in enumerate(want) if r[0] is not None], 5, 80)}
    groups = defaultdict(list)
    for k, c in root.items():
        groups[c].append(want[k][0])
    left = take(stages[2])
    assert len(left) == len(groups) + sum(r[0] is None for r in want) and set(left) <= set(want)
    assert Counter(r[0] for r in left if r[0] is not None) == Counter(min(ids) for ids in groups.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {k for k, *_, hit in brute_leaks([(k, r[1]) for k, r in enumerate(left)], items) if hit}
    want = [r for k, r in enumerate(left) if k not in bad]
    assert by_text(want) == by_text(take(stages[3])) and len(want) > 80
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r[0] for r in want)
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= -(-total // packing.CAPACITY) + 3


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
