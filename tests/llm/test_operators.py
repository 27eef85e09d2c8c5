"""The dealt operators against brute force, on whole small tables with added edge rows."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, ngram_join, packing, scratch, sharding, tokens, topk, training_order, warc, wordpiece

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, h string, t string, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, empties, a very long text, repeated rows and columns of clashing names."""
    own = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(120).collect()]
    base = own[3][1]
    odd = [
        (1001, None), (1002, ""), (1003, " \n\t"), (1004, "One"), (1005, "one two"), (1006, "ONE two three"), (1006, "one two three"),
        (1007, "ÀÉ x"), (1008, base), (1008, base), (1009, base + " tail"), (1010, "head " + base), (1011, base[: len(base) // 2]),
        (1012, "word " * 30_000), (1013, " ".join(f"w{i}" for i in range(5000))), (1014, "!!! ... ,,,"), (1015, "x" * 5000),
    ]
    rows = own + [(i, t, None, None, None) for i, t in odd]
    # A family of near copies of one text, larger than a posting list may be.
    words = [f"k{i}" for i in range(300)]
    for i in range(60):
        own_words = list(words)
        own_words[(i * 5) % 300] = f"z{i}"
        own_words[(i * 7 + 3) % 300] = f"y{i}"
        rows.append((2000 + i, " ".join(own_words), "en", "src1", None))
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3).cache()


def pairs_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def words9(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(-5000, 5000)
    for n in range(1, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.min() >= 0 and a.max() < n
    assert np.bincount(sharding.jump(np.arange(160_000), 16)).std() < 200


def test_sharding(docs):
    out = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    assert len(out) == docs.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs_of(docs, "doc_id", "text"))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_best_fit_packing(docs):
    path = tokens.vocabulary("word_bpe_49k.json")
    out = [r.asDict() for r in packing.pack_documents(docs).collect()]
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(path), []
    for i, t in pairs_of(docs, "doc_id", "text"):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((i, piece, at, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
    assert sorted(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == sorted(want)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= max(packing.best_fit([w[3] for w in want], 2048)) + 2


def test_packing_merges_up_the_tree(spark):
    pieces = spark.range(4000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + pmod(id * 7919, 700) as length", "0L as ids_crc32")
    one = packing.pack_best_fit(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    tree = packing.pack_best_fit(pieces, fan_in=2, a_partition=400)
    sums = tree.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("o"), F.count("*").alias("c")).collect()
    assert all(r.n == r.end <= 2048 and r.o == r.c for r in sums) and tree.count() == 4000
    assert len(sums) <= one.count() + 12


def test_tokens_are_those_of_the_tokenizer():
    path = tokens.vocabulary("word_bpe_49k.json")
    own = tokens.WordCachedTokenizer(path)
    texts = ["Don't STOP, it's we'll. a., .a ,. 12,3 x1. É, ß. 'S 's.", "Ωs ΑΣ.  b\x1cc \x85d é fi<|endoftext|>", "", "A  B\r\n\tc,"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)]
        assert got == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_random_texts(monkeypatch):
    """Any mix of capitals, marks, stops and odd spaces, with a cache too small for it and texts cut into parts."""
    own = tokens.WordCachedTokenizer(tokens.vocabulary("word_bpe_49k.json"), 1 << 16)
    rng = np.random.default_rng(2)
    letters = list("aAbEsStTİıŉΣσςßK’“.,;!-_#<|>0123 \t\n\r\x0b\x1c\x85\xa0éÉÿŸ×²ªĲſ漢🙂") + ["\u0301", "\u0307", "\u200b", "<|endoftext|>", "</w>", "'ll", "GELDİ.", "word. "]
    for k in range(3000):
        if k == 2500:
            monkeypatch.setattr(tokens, "SLICE", 16)
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert np.frombuffer(own.ids([text, ""])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 5001])
def test_feistel_is_a_permutation(n):
    out = training_order.feistel(np.arange(n), n, 7)
    assert sorted(out) == list(range(n))
    assert (training_order.feistel(out, n, 7, inverse=True) == np.arange(n)).all()
    if n > 1000:
        assert (out != training_order.feistel(np.arange(n), n, 8)).mean() > 0.9


def test_training_order(spark, docs):
    written = scratch.stage(docs.select("doc_id", "text"), "docs")
    shards = training_order.materialise(written, scratch.fresh(spark, "t"), key=5, stride=32)
    out = [r.asDict() for r in training_order.read_shards(shards).collect()]
    n = docs.count()
    assert sorted(r["slot"] for r in out) == list(range(n)) and all(r["shard"] == r["slot"] // 32 for r in out)
    encoding = tokens.byte_tokenizer(tokens.vocabulary("byte_bpe_50k.tiktoken"))
    want = []
    for i, t in pairs_of(docs, "doc_id", "text"):
        ids = np.asarray(encoding.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(want)
    late = training_order.read_shards(shards, from_slot=100).collect()
    assert sorted(r.slot for r in late) == list(range(100, n))


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=24)]) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(700, None), (720, []), (721, [1.0, None]), (722, [float("nan")] * 24), (740, [1.0, 2.0]), (741, [2.0, 1.0]), (None, rows[1][1]), (20, rows[20][1])]
    rows += [(21, rows[3][1]), (21, rows[40][1]), (40, rows[40][1])]  # repeated ids: other rows
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    good = [(i, np.floor(64 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-int(x @ v), i) for n, (i, v) in enumerate(good) if n != at and len(v) == len(x))[:20]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    for blocks in ((4096, 8192), (7, 50)):
        got = sorted(tuple(r) for r in topk.top_k(df, query_block=blocks[0], candidate_block=blocks[1]).collect())
        assert got == sorted(want)


def brute_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, n, percent):
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs, n, percent).collect())
    assert got == brute_components(pairs_of(docs, "doc_id", "text"), n, percent)


def test_ngram_join_keeps_chains_and_stars(spark):
    """Near copies that are linked with some of a family only, by way of others."""
    rng, rows = np.random.default_rng(5), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for i in range(90):
            own = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 6)):
                own[k] = f"x{rng.integers(0, 9)}"
            rows.append((family * 1000 + i, " ".join(own)))
    for i in range(60):  # short texts around one common line
        rows.append((5000 + i, "the common line of many texts " + " ".join(f"u{i}v{k}" for k in range(i % 7))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(tuple(r) for r in ngram_join.jaccard_components(df, n, percent).collect())
        assert got == brute_components(rows, n, percent)


def test_keep_one(docs):
    """One row of each component; rows of one id with different texts go by their own text."""
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    rows = pairs_of(docs, "doc_id", "text")
    root = {k: c for k, _, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)}
    groups = defaultdict(list)
    for k, c in root.items():
        groups[c].append(rows[k][0])
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(ids) for ids in groups.values())


def test_keep_one_decides_per_row(spark):
    words = [f"a{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (1, "completely other words than those of the first row here"), (2, " ".join(words[:-1] + ["z"])), (None, " ".join(words)), (None, None), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "g") for r in rows], "doc_id long, text string, __gone string")
    assert sorted(map(str, (tuple(r)[:2] for r in ngram_join.keep_one(docs).collect()))) == sorted(map(str, [rows[0], rows[1], rows[3], rows[4], rows[5], rows[6]]))


def test_ngram_join_of_families_of_families(spark):
    """Families whose leaders are far apart, with lists longer than those that are expanded."""
    rng, rows, bases = np.random.default_rng(7), [], [[f"b{k}" for k in range(150)]]
    for g in range(3):
        base = list(bases[rng.integers(0, len(bases))])
        for k in rng.choice(150, 18, replace=False):
            base[k] = f"g{g}e{k}"
        bases.append(base)
    for base in bases:
        for _ in range(60):
            own = list(base)
            for k in rng.integers(0, 150, rng.integers(0, 7)):
                own[k] = f"z{rng.integers(0, 12)}"
            rows.append((len(rows), " ".join(own)))
    for i in range(120):  # one passage, few own words
        rows.append((len(rows), " ".join([f"p{k}" for k in range(40)] + [f"u{i}x{k}" for k in range(i % 5)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (2, 50)):
        assert sorted(tuple(r) for r in ngram_join.jaccard_components(df, n, percent).collect()) == brute_components(rows, n, percent)


def test_word_pieces_match_greedy(docs):
    import sentencepiece

    path = tokens.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    first, inner = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if "▁" not in p}
    longest = max(map(len, pieces))

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            own = inner if at else first
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in own), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    want = []
    for i, t in pairs_of(docs, "doc_id", "text"):
        found = [greedy(w) for w in re.findall(r"\w+|[^\w\s]", (t or "").lower())]
        want.append((i, len(found), sum(n or 1 for n in found), found.count(0)))
    assert sorted(tuple(r) for r in wordpiece.count_tokens(docs).collect()) == sorted(want)


def test_small_automaton_pops_through_failures():
    a = wordpiece.Automaton({"a", "abcdx", "b"}, {"b", "c", "cdy", "dz", "d"})
    assert [a.count(w) for w in ("abcdz", "abcdx", "abcdy", "abc", "abq", "z", "b")] == [4, 1, 3, 3, 0, 0, 1]


def brute_leaks(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = words9(t)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            wins[tuple(w[s : s + size])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = words9(t), set(), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in wins:
                    hit.update(range(s, s + size))
                    found |= wins[tuple(w[s : s + size])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, docs):
    rows = pairs_of(docs, "doc_id", "text")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    long = rows[5][1].split()
    items += [
        (900, None), (901, ""), (902, "..."), (903, "one"), (904, "One TWO"), (905, "k7 k8 k9 k10 k11 k12"), (906, " ".join(f"w{i}" for i in range(40, 52))),
        (907, "word word word word word word word word word word word"), (908, " ".join(long[4:13])), (908, " ".join(long[4:13])), (None, "w77 w78 w79"), (909, "ààà w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 w110"),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = sorted(tuple(r) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == brute_leaks(rows, items)
    none = decontaminate.decontaminate(docs, bench.limit(0))
    assert sorted(tuple(r) for r in none.collect()) == brute_leaks(rows, [])


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", "<p>é" + "x" * (i % 7) * 50) for i in range(200)]
    rows += [(300, None, None), (199, "again", "<p>é" + "x" * 150), (301, "u\r\nInjected: 1", ""), (None, "n", "alone"), (None, "n", "<p>é"), (-5, "neg", "minus"), (400, "v", "long " * 400_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(df, scratch.fresh(spark, "w"), frame_bytes=2000)
    back = [r.asDict() for r in warc.read_archives(index, payloads=True).collect()]
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = []
    for i, _, h in rows:
        data, keep = (h or "").encode(), best.get(h or "")
        own = keep is None or keep == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else keep))
    got = [tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in back]
    assert sorted(map(str, got)) == sorted(map(str, want))
    file = index.orderBy(F.desc("records")).first().file
    reader = warc.BundleReader(file)
    assert len(reader.frames) > 1
    some = [x for x in reader.records() if x["page_id"] is not None][-1]
    assert reader.find(some["page_id"]) == some and reader.find(99999) is None
    # Any record by its id, whatever bundle holds it.
    places = warc.record_map(index)
    assert places.count() == len(rows)
    wanted = [7, 300, -5, 400, 99999]
    found = {r.page_id: warc.parse_record(r.record) for r in warc.fetch(places, spark.createDataFrame([(i,) for i in wanted], "page_id long")).collect()}
    assert set(found) == {7, 300, -5, 400} and all(found[i] == {r["page_id"]: r for r in back}[i] | {"payload": found[i]["payload"]} for i in found)
    # The frames are one Zstandard stream to any other reader.
    import zstandard

    with open(file.removeprefix("file://"), "rb") as raw:
        data = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert data.count(b"WARC/1.1\r\n") == len(reader.index)


def test_least_size_for_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_pages(df, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        sharding.shard_documents(docs), packing.pack_documents(docs), training_order.training_order(scratch.stage(docs, "none")), topk.top_k(vectors),
        ngram_join.jaccard_components(docs), wordpiece.count_tokens(docs), decontaminate.decontaminate(docs, bench), warc.archive_pages(pages),
    ):
        assert df.collect() == []
