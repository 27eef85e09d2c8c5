"""Semantics that the tables do not exercise, on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import backend as B
from quillspark.functions import text as T
from quillspark.operators import chat, compose, consensus, evaluation, ledger, markdown, sampling, search, sequence, versions
from quillspark.sources import readers, sinks, workspace


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


def test_tokens_split_at_unicode_space(spark):
    assert column(spark, "A b  C\n", T.tokens) == ["a", "b", "c"]
    assert column(spark, " ".join("w" * 1 for _ in range(3)), T.token_estimate) == 3
    assert column(spark, None, T.token_estimate) == 0


@pytest.mark.parametrize("days,text", [(0, "today"), (1, "yesterday"), (6, "6 days ago"), (7, "1 week ago"), (28, "4 weeks ago"), (30, "1 month ago"), (59, "1 month ago"), (60, "2 months ago")])
def test_relative_time(spark, days, text):
    assert column(spark, days, T.relative_time, "int") == text


def test_fences_and_slugs(spark):
    assert column(spark, "```json\n[1]\n```", T.strip_fences) == "[1]"
    assert column(spark, " {} \n", T.strip_fences) == "{}"
    assert column(spark, "A---B c", T.slug) == "a--b-c"


def test_length_bounds_are_inclusive(spark):
    def convs(*texts):
        rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] or [(1, 0, "user", "hi")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return chat.collect_messages(df).select(chat.length_ok()).first()[0]

    ten, many = " ".join(["w"] * 8), " ".join(["w"] * 385)  # 10 and 500 estimated tokens
    assert convs(ten, many) and not convs(ten, "w") and not convs(many + " w") and not convs()
    assert convs(ten, "")  # an empty reply is not visible


def test_bm25l_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a a c d"), (2, "e")], "id long, t string")
    queries = spark.createDataFrame([(0, "A a x"), (1, "zz")], "query_id int, query string")
    got = {(r.query_id, r.id): r.score for r in search.bm25l(docs, "id", F.col("t"), queries).collect()}

    def one(tf, dl):
        ctd = tf / (1 - 0.75 + 0.75 * dl / (7 / 3))
        return 2 * (math.log(4) - math.log(2.5)) * 2.5 * (ctd + 0.5) / (1.5 + ctd + 0.5)

    assert set(got) == {(0, 0), (0, 1), (0, 2)}  # every document scores once a term is known; unknown queries give nothing
    for (_, i), (tf, dl) in zip(sorted(got), ((1, 2), (2, 4), (0, 1))):
        assert got[0, i] == pytest.approx(one(tf, dl))


def test_ties_go_to_the_later_document(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(9)], "id long, t string")
    scored = search.bm25l(docs, "id", F.col("t"), spark.createDataFrame([(0, "words")], "query_id int, query string"))
    assert [r.id for r in search.best(scored, 3, F.desc("score"), F.desc("id")).collect()] == [8, 7, 6]


def test_sessions(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 5, None), ("b", 1, False)]
    df = spark.createDataFrame(rows, "k string, p int, f boolean")
    flags = sorted((r.k, r.p, r.session) for r in sequence.sessions_by_flag(df, ["k"], ["p"], F.col("f")).collect())
    assert [s for *_, s in flags] == [0, 0, 1, 1, 0]
    gaps = sorted((r.k, r.p, r.session) for r in sequence.sessions_by_gap(df, ["k"], "p").collect())
    assert [s for *_, s in gaps] == [0, 0, 0, 1, 0]


def test_triplets_and_stability(spark):
    rows = [("m-001-A", True, None), ("m-001-B", True, None), ("m-001-C", None, 4.0), ("m-002-A", True, None), ("m-002-B", False, None), ("m-002-C", None, 3.0), ("m-003-A", True, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "prompt_id string, pass boolean, score double, seq int")
    assert tuple(evaluation.triplets(df).first()) == (2, 0.5)
    df = spark.createDataFrame([({"turn_0": 5.0, "turn_1": 4.0, "turn_2": 1.0},), ({"turn_0": 5.0, "turn_3": 5.0},)], "sub_scores map<string,double>")
    assert tuple(evaluation.stability(df).first()) == (2, 5, 0.8)
    assert evaluation.stability(df.limit(0)).first().mean_score == 0.0


def test_ledger_paths_and_support(spark):
    paths = ["identity/a", "identity", "identity/a/b/c", "identity/a/b/c/d", "nope/a", "history//x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(ledger.valid_path(F.col("path"))).collect()] == [True, False, True, False, False, False]
    events = spark.createDataFrame([(1, 1, "support", 0), (1, 1, "support", 1), (1, 2, "contradict", 2), (1, 3, "support", 3)], "claim_id long, scene_id long, kind string, seq int")
    assert tuple(ledger.support(ledger.apply_events(events)).first()) == (1, 1, 1)
    assert ledger.support(ledger.refine(ledger.apply_events(events))).first().support == 3


def test_condense_keeps_singletons(spark):
    df = spark.createDataFrame([(1, "x", "identity/a/b", "episode", 2), (2, "y", "identity/a/b", "general", 5), (3, "z", "history/q", "episode", 1)], "claim_id long, text string, path string, scope string, support long")
    got = sorted(tuple(r) for r in ledger.condense(df).collect())
    assert got == [(2, "y", "identity/a/b", "general", 7), (3, "z", "history/q", "episode", 1)]


def test_segments(spark):
    text = "lead\n# top\n## A\nx\n### B\ny\n#### deep\n## C\n### D\n## E\n\n"
    df = spark.createDataFrame([("f.md", text)], "file_path string, content string")
    got = [(r.segment_id, r.level, r.content) for r in markdown.segments(df).orderBy("segment").collect()]
    assert got == [("f.md", 1, "lead\n# top"), ("f.md::A", 2, "x"), ("f.md::A::B", 3, "y\n#### deep"), ("f.md::E", 2, "")]


def test_compact_drops_a_short_tail(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a" * 6, "b" * 6, "c" * 3])], "k int, o int, t string")
    assert [r.content for r in markdown.compact(df, "k", "o", "t", 4, 14).orderBy("chunk").collect()] == ["aaaaaa\n\nbbbbbb"]


def test_consensus():
    takes = [(0, 0, "Ann", "hello there friend", 0.9), (1, 0, "Ann", "hello there, friend", 0.8), (2, 0, "Bob", "hello there friend", 0.7), (0, 1, "Bob", "goodbye", 0.5)]
    out = consensus.merge_takes(takes, 3)
    assert [(c, t, n) for c, t, _, _, n in out] == [("Ann", "hello there friend", 3), ("Bob", "goodbye", 1)]
    assert out[0][3] == pytest.approx(2 / 3) and out[0][2] == pytest.approx(0.6 * 2 / 3 + 0.4 * 0.8)


def test_consensus_of_whole_documents(spark):
    from difflib import SequenceMatcher

    from quillspark.plans import relational

    docs = {r.doc_id: r.text for r in relational.documents(spark, "/root/testdata/sf0.001").collect()}
    lines = {(r.page, r.pos): r.text for r in relational.takes(spark, "/root/testdata/sf0.001").where("take = 0").collect()}
    assert lines == {(i, k): f"{x} said the one" for i, t in docs.items() for k, x in enumerate(t.split("\n"))}
    assert consensus.ratio("HELLO", "hello") == 1.0

    def plain(texts):
        leaders, out = [], []
        for t in texts:
            out.append(next((i for i, x in enumerate(leaders) if SequenceMatcher(None, t.lower(), x.lower()).ratio() > 0.8), len(leaders)))
            if out[-1] == len(leaders):
                leaders.append(t)
        return out

    for t in list(docs.values())[:12]:
        texts = [y for x in t.split("\n")[:20] for y in (x, x.upper(), x[: len(x) * 5 // 7], x[::2] + x[len(x) // 2 :], "")]
        assert consensus.first_clusters(texts) == plain(texts)


def test_sets_and_gaps_of_all_rows(spark, tmp_path):
    from quillspark.plans import registry, retrieval

    rows = [(1, "a", "en"), (5000, "a", "fr"), (5003, "a", "fr"), (9000, "b", "en"), (2, "c", "de"), (301, "c", "en"), (302, "c", "it")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("flt13_exact_character_set") == [("a",)]
    assert run("set06_set_algebra") == [("a", "en", "de,it"), ("b", "en", "de,it"), ("c", "de,en,it", "")]
    gaps = [("a", i) for i in range(2, 5003) if i != 5000] + [("c", i) for i in range(3, 301)]
    assert run("flt25_missing_positions") == gaps
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, retrieval.missing_positions(docs, "source", "doc_id", 3).collect())) == gaps


def test_extraction_parts_and_memory_handling(spark):
    line = "array<struct<character:string,text:string>>"
    rows = [
        ([("a", "x"), ("b", "y")], [("a", "x"), ("b", "y")], 1.0), ([("a", "x"), ("b", "z")], [("a", "x"), ("b", "y")], 0.875),
        ([("a", "x")], [("a", "x"), ("b", "y")], 0.25), ([("b", "y"), ("a", "x"), ("c", "z")], [("a", "x"), ("b", "y")], 0.0), ([], [("a", "x")], 0.0), ([("a", "x")], [], 0.0), ([], [], 1.0),
    ]
    df = spark.createDataFrame(rows, f"p {line}, g {line}, want double")
    assert all(r.got == r.want for r in df.select(evaluation.extraction_parts(F.col("p"), F.col("g")).alias("got"), "want").collect())
    rows = [("m-1-A", True, None), ("m-1-B", True, None), ("m-1-C", None, 4.0), ("m-2-C", None, 1.0), ("m-3-C", None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "prompt_id string, pass boolean, score double, seq int")
    assert tuple(evaluation.memory_handling(df).first()) == (2.5, 2, 1, 1.0)
    assert tuple(evaluation.memory_handling(df.limit(0)).first()) == (0.0, 0, 0, 0.0)


def test_whole_texts_are_carried(spark, tmp_path):
    from difflib import SequenceMatcher

    from quillspark.plans import registry

    long = "The first line, \"quoted\".\n\n" + " ".join(f"word{i % 97}" for i in range(600))
    texts = [long, long + "\nlast, line\n", "  led by blanks and \\ slashes  ", "one\r\ntwo", "short"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    want = {i: round(SequenceMatcher(None, t.lower(), t[10:].lower()).ratio(), 6) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ratio for r in run("agg20_similarity")} == want
    assert {r.doc_id: (r.text, r.plain) for r in run("src18_csv_json_cells")} == {i: (t, t) for i, t in enumerate(texts)}
    assert {r.key: r.value for r in run("src04_memory_bank")} == {str(i): t for i, t in enumerate(texts)}
    assert f"{sum(len(t) + 3 for t in texts) - 1} characters" in run("udf08_compact_memories")[0].text


def test_sampling_is_reproducible_and_weighted(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = [r.k for r in sampling.sample(df, 30, "s", "k").collect()]
    assert a == [r.k for r in sampling.sample(df.repartition(7), 30, "s", "k").collect()] and len(set(a)) == 30
    heavy = sampling.weighted_sample(df, 300, "s", "k", F.when(F.col("k") < 1000, 10.0).otherwise(1.0)).where("k < 1000").count()
    assert heavy > 240


def test_scenario_space(spark):
    sizes = (6, 15, 15, 10, 2)
    dims = [spark.range(n).withColumnRenamed("id", f"d{i}") for i, n in enumerate(sizes)]
    rows = compose.product(*dims)
    pairs = spark.createDataFrame([(i % 15, i % 3) for i in range(14)], "d1 long, d0 long")
    assert rows.count() == 27_000 and compose.excluding(rows, pairs.distinct(), ["d0", "d1"]).count() == 27_000 - 14 * 15 * 10 * 2


def test_readers(spark):
    path = workspace.fresh(spark, "lines")
    lines = ['{"key": "a", "value": "1", "days_ago": 4}', "", '{"key": "b", "value": "2"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    assert sorted(tuple(r) for r in readers.memory_bank(spark, path).collect()) == [("a", "1", 4), ("b", "2", 0)]
    bad = workspace.fresh(spark, "bad")
    spark.createDataFrame([(x,) for x in [*lines, '{"key": ']], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception):
        readers.strict(spark, bad, readers.MEMORY).collect()
    assert sorted(r.id for r in readers.tolerant_ids(spark, bad, "key").collect()) == ["a", "b"]


def test_page_tree(spark):
    root = workspace.fresh(spark, "pages")
    page = {"summary": "s", "panels": [{"is_new_scene": True, "dialogues": [{"character": "A", "line": "x"}]}]}
    from pathlib import Path

    for name, body in (("i1/page_007.json", json.dumps(page, indent=1)), ("i1/page_008.json", "{broken")):
        file = Path(root.removeprefix("file://")) / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body)
    got = readers.pages(spark, root).collect()
    assert [(r.issue, r.page_num, r.panels[0].dialogues[0].line) for r in got] == [("i1", 7, "x")]


def test_resume_writes_each_id_once(spark):
    path = workspace.fresh(spark, "resume")
    inputs = spark.range(10)
    assert sinks.run_resumable(inputs.limit(4), path, ["id"], lambda df: df.where("id <> 2")) == 3
    assert sinks.run_resumable(inputs, path, ["id"], lambda df: df) == 7
    assert sinks.run_resumable(inputs, path, ["id"], lambda df: df) == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_patches_replay():
    a, b = "one\ntwo\nthree\n", "one\n2\nthree\nfour\n"
    for x, y in ((a, b), (b, a), ("", a), (a, ""), (a, a)):
        assert versions.patch(x, versions.unified(x, y)) == y


def test_document_tree_round_trip():
    text = "# A\nx\n## B\n\ny\n### C\n# D"
    rows = versions.parse_tree(text)
    assert versions.render_tree(rows) == text
    assert [r["parent_path"] for r in rows if r["header"] == "C"] == [["A", "B"]]


def test_backend_loop_and_registry():
    def recall(query: str, limit: int = 3) -> str:
        """Finds memories."""
        return query * limit

    tools = B.Tools({"recall": recall})
    schema = tools.schemas()[0]
    assert schema["parameters"]["required"] == ["query"] and schema["parameters"]["additionalProperties"] is False
    with pytest.raises(KeyError):
        tools.select(["nope"])
    script = B.Scripted([B.Reply(calls=[("recall", {"query": "a"})]), B.Reply(calls=[("recall", {"bad": 1})]), B.Reply("end")])
    text, log = B.converse(script, "", "u", tools)
    assert text == "end" and log[0]["result"] == "aaa" and log[1]["result"].startswith("Error")
    assert B.converse(lambda s, m: B.Reply(calls=[("recall", {"query": "a"})]), "", "u", tools)[0] is None


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert B.with_retries(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    assert B.backoff(10) == 60 and B.batch_size(27) == 9 and B.batch_size(20) == 10


@pytest.mark.parametrize("name", ["flt10_low_confidence", "flt11_quality_pages"])
def test_means_are_added_up_in_the_order_of_rows(spark, tmp_path, name):
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillspark.plans import registry

    rng = random.Random(1)
    orders = rng.sample([i for i in range(3000) for _ in range(6)], 18000)
    rows = {"l_orderkey": orders, "l_discount": [rng.randrange(11) / 100 for _ in orders], "l_returnflag": rng.choices("RAN", k=len(orders))}
    pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet", row_group_size=600)
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "8k")
    try:
        found = registry.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(duck.sql(registry.ORACLE_SQL[name]).fetchall())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_groups_of_texts_are_written_up_without_one_cell(spark):
    from quillspark.operators import agents

    rows = [("a", i, t) for i, t in enumerate(["one", "two\nlines", "", None, "日本\n\n"])] + [("b", 0, "x"), (None, 1, "y\n"), ("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    out = agents.rewritten(df, agents.Listing(), "Go.", "k", "o", "t")
    plain = agents.rewritten(df, lambda s, m: agents.Listing()(s, m), "Go.", "k", "o", "t")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_list" in plain._jdf.queryExecution().optimizedPlan().toString()


def test_archives_are_packed_in_parts(spark, tmp_path, monkeypatch):
    import io
    import lzma
    import tarfile

    import pyarrow.fs as pafs

    from quillspark.sources import archives

    monkeypatch.setattr(archives, "PART", 3000)
    monkeypatch.setattr(archives, "HELD", 1000)
    files = {(a, f"{i}.txt"): f"{a} {i} é ".encode() * (i % 40) for a in ("x.tar.xz", "y.tar.xz") for i in range(300)}
    df = spark.createDataFrame([(*k, bytearray(v)) for k, v in files.items()], "archive string, name string, data binary")
    root = f"file://{tmp_path}/own"
    assert archives.write_archives(df, root) == 2
    for a in ("x.tar.xz", "y.tar.xz"):
        with tarfile.open(tmp_path / "own" / a) as t:
            assert [(m.name, t.extractfile(m).read()) for m in t] == sorted((n, v) for (x, n), v in files.items() if x == a)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "own" / a)) as f:
            assert len(archives.tar_parts(f)) > 10
    back = lambda where: {(r.archive.rpartition("/")[2], r.name): bytes(r.data) for r in archives.unpack(spark, where).collect()}
    assert back(root) == files
    assert sorted(p.name for p in (tmp_path / "own").iterdir() if not p.name.endswith(".crc")) == ["x.tar.xz", "y.tar.xz"]
    # of other origin: one stream, or streams that cut files; a broken one
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in ("a", "b"):
            info = tarfile.TarInfo(n)
            info.size = 2000
            t.addfile(info, io.BytesIO(n.encode() * 2000))
    data = out.getvalue()
    (tmp_path / "other").mkdir()
    for n, streams in (("one", [data]), ("cut", [data[:1000], data[1000:]])):
        (tmp_path / "other" / f"{n}.tar.xz").write_bytes(b"".join(map(lzma.compress, streams)))
    (tmp_path / "other" / "bad.tar.xz").write_bytes(b"no archive")
    assert back(f"file://{tmp_path}/other") == {(f"{n}.tar.xz", m): m.encode() * 2000 for n in ("one", "cut") for m in "ab"}


def test_bounds_of_similar_lines_change_no_cluster(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    kinds = ["abcdefghijklmnopqrstuvwxyz ", "eeeeaaaatttt nnniiissshhrrdlu,.", "éàüß abcdefABCDEF", "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "ΑΣσςİı\ud800\0 "]

    def changed(t, share):
        return "".join(rng.choice(t) if rng.random() < share else c for c in t)

    def plain(texts):
        leaders, out = [], []
        for t in texts:
            out.append(next((i for i, x in enumerate(leaders) if SequenceMatcher(None, t.lower(), x.lower()).ratio() > 0.8), len(leaders)))
            if out[-1] == len(leaders):
                leaders.append(t)
        return out

    monkeypatch.setattr(consensus.Lines, "BLOCK", 16)
    for round_ in range(30):
        texts = []
        for _ in range(10):
            t = "".join(rng.choices(kinds[round_ % len(kinds)], k=rng.choice([0, 1, 2, 3, 30, 190, 199, 200, 201, 260, 400])))
            texts += [t, changed(t, 0.03), changed(t, 0.15), t[len(t) // 5 :], t[: len(t) // 2] + " and more " + t[len(t) // 2 :], t.upper()]
        rng.shuffle(texts)
        assert consensus.first_clusters(texts) == plain(texts)
    # long lines of like letters are never aligned, nor are their subsequences sought
    monkeypatch.setattr(consensus.Lines, "in_line", lambda self, i, leaders: [1 / 0] if leaders else [])
    words = ["".join(rng.choices(kinds[1].replace(" ", ""), k=rng.randrange(2, 9))) for _ in range(4000)]
    assert consensus.first_clusters([" ".join(rng.choices(words, k=80)) for _ in range(40)]) == list(range(40))


def test_consensus_of_pages_across_batches(spark):
    rows = [(p, t, k, f"c{k % 2}", f"page {p} line {k} {'x' * (k % 7)}", 0.5) for p in (None, 1, 2, 3) for k in range(5) for t in range(3)]
    df = spark.createDataFrame(rows, "page long, take int, pos int, character string, text string, confidence double")
    want = [(p, i, *x) for p in (None, 1, 2, 3) for i, x in enumerate(consensus.merge_takes([r[1:] for r in rows if r[0] == p], 3))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, consensus.consensus(df).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
