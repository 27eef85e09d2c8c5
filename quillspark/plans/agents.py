"""Queries of knowledge tools, memories, judges, simulated users, claims, profile edits and literal prompts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import backend as B
from ..operators import agents, consensus, knowledge, markdown, prompts
from ..sources import archives, readers, sinks, workspace
from ..streaming import incremental
from .base import query, table
from .relational import as_markdown
from .retrieval import documents

CALLS = [(0, "sub text"), (1, "H1 last"), (2, "zzz qqq"), (3, " "), (4, "intro intro 3")]


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def bm25_sql(corpus: str, rows: list) -> str:
    """Common tables up to r (query_id, key, score, rank) of the BM25L formula over a corpus (key, text)."""
    split = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"
    return f"""corpus AS ({corpus}), calls AS (SELECT * FROM (VALUES {values(rows)}) t(query_id, query)),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({split.format('query')}) AS term FROM calls) GROUP BY ALL),
tk AS (SELECT key, {split.format('text')} AS toks FROM corpus), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk),
po AS (SELECT key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT key, len(toks) AS dl, unnest(toks) AS term FROM tk) GROUP BY key, term),
we AS (SELECT query_id, qt.term, qtf, ln(st.n + 1.0) - ln(f.df + 0.5) AS idf, st.avgdl FROM qt JOIN (SELECT term, count(*) AS df FROM po GROUP BY term) f USING (term), st),
sc AS (SELECT we.query_id, tk.key, sum(we.idf * we.qtf * 2.5 * (coalesce(po.tf / (0.25 + 0.75 * po.dl / we.avgdl), 0) + 0.5) / (1.5 + coalesce(po.tf / (0.25 + 0.75 * po.dl / we.avgdl), 0) + 0.5)) AS score
FROM we CROSS JOIN tk LEFT JOIN po ON po.key = tk.key AND po.term = we.term GROUP BY ALL),
r AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, key DESC) AS rank FROM sc QUALIFY rank <= 5 AND score > 0)"""


SEGMENTS = """seg AS (SELECT f || '#' || lpad(n::VARCHAR, 9, '0') AS place, f AS file_path, p AS section, c AS content FROM (SELECT 'w/' || page_id || '.md' AS f, url, page_id FROM pages), LATERAL (
SELECT 0 AS n, []::VARCHAR[] AS p, 'intro ' || url AS c UNION ALL SELECT 1, ['H' || (page_id % 5)], url UNION ALL SELECT 2, ['H' || (page_id % 5), 'Sub'], 'text of ' || page_id UNION ALL SELECT 4, ['Last'], '') x)"""
TOKENS = "CAST(floor(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) * 13 / 10) AS BIGINT)"


@query("src15_wiki_tree", "SELECT n_name AS file, 'n' || n_regionkey AS folder, 'body of ' || n_name || chr(10) || 'end' AS content FROM nation")
def src15(spark, d):
    """Markdown files of a folder tree, whole, one row each; other files are passed over."""
    root, n = workspace.fresh(spark, "wiki"), table(spark, d, "nation").withColumn("n_name", F.col("n_name"))
    body = F.concat(F.lit("body of "), "n_name", F.lit("\nend"))
    path = lambda end: F.concat(F.format_string("n%d/%d", "n_regionkey", "n_nationkey"), F.lit(end)).alias("path")
    archives.write_files(n.select(path(".md"), body.alias("data")), root)
    archives.write_files(n.select(path(".txt"), body.alias("data")), root)
    files = readers.markdown(spark, root).withColumn("n_nationkey", F.regexp_extract("file_path", r"(\d+)\.md$", 1).cast(n.schema["n_nationkey"].dataType))
    return files.join(n, "n_nationkey").select(F.col("n_name").alias("file"), F.regexp_extract("file_path", r"/(n\d+)/[^/]+$", 1).alias("folder"), "content")


@query("prj33_split_markdown", f"WITH {SEGMENTS} SELECT file_path, array_to_string(section, ' > ') AS heading, len(section) AS depth, {TOKENS} AS tokens FROM seg")
def prj33(spark, d):
    s = markdown.segments(as_markdown(spark, d))
    return s.select("file_path", F.array_join("section_path", " > ").alias("heading"), F.size("section_path").cast("long").alias("depth"), F.col("token_count").alias("tokens"))


@query("prj31_blocks", """SELECT page_id, unnest([0, 3, 7, 14, 16]) AS pos, unnest([false, false, true, false, false]) AS fenced,
unnest(['intro ' || url, 'one' || chr(10) || 'two', '```py' || chr(10) || 'x = 1' || chr(10) || chr(10) || '# no heading' || chr(10) || '```', 'deep', 'last']) AS text, unnest(['', 'T', 'T', 'T/S/U', 'V']) AS headings FROM pages""")
def prj31(spark, d):
    """Paragraphs and fenced blocks, each under its headings."""
    body = F.concat(F.lit("intro "), "url", F.lit("\n\n# T\none\ntwo\n\n\n```py\nx = 1\n\n# no heading\n```\n## S\n### U\ndeep\n# V\nlast"))
    blocks = markdown.blocks(table(spark, d, "pages").select(F.col("page_id").alias("file_path"), body.alias("content")))
    return blocks.select(F.col("file_path").alias("page_id"), "pos", "fenced", "text", F.array_join("headings", "/").alias("headings"))


def calls(spark):
    return spark.createDataFrame(CALLS, "query_id long, query string")


@query("top02_segment_search", f"WITH {SEGMENTS}, " + bm25_sql("SELECT place AS key, array_to_string(section, ' ') || ' ' || content AS text FROM seg", CALLS) + " SELECT CAST(query_id AS BIGINT) AS query_id, rank, key AS place, round(score, 6) AS score FROM r")
def top02(spark, d):
    """Wiki search: files to segments, BM25L over headings and content, five best above 0."""
    found = knowledge.hits(knowledge.index(as_markdown(spark, d)), calls(spark))
    return found.select("query_id", "rank", "place", F.round("score", 6).alias("score"))


@query("udf05_search_knowledge", f"WITH {SEGMENTS}, " + bm25_sql("SELECT place AS key, array_to_string(section, ' ') || ' ' || content AS text FROM seg", CALLS) + f""",
e AS (SELECT query_id, rank, rank || '. [' || array_to_string(list_concat([file_path], section), '::') || ']' || chr(10) || '   Path: ' || array_to_string(list_concat([file_path], section), ' > ') || chr(10) || '   Snippet: ' || trim(left(content, 200)) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END || chr(10) || '   (~' || {TOKENS} || ' tokens)' AS e FROM r JOIN seg ON key = place),
g AS (SELECT query_id, count(*) AS n, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS body FROM e GROUP BY query_id)
SELECT CAST(c.query_id AS BIGINT) AS query_id, CASE WHEN trim(query) = '' THEN 'Error: Please provide keywords to search for' WHEN n IS NULL THEN 'No entries found for ''' || query || '''' ELSE 'Found ' || n || ' matches for ''' || query || ''':' || chr(10) || chr(10) || body || chr(10) END AS answer FROM calls c LEFT JOIN g ON c.query_id = g.query_id""")
def udf05_search(spark, d):
    return knowledge.search_knowledge(knowledge.index(as_markdown(spark, d)), calls(spark))


@query("udf05_read_knowledge", f"""WITH {SEGMENTS}, c AS (SELECT page_id AS call_id, CASE WHEN page_id % 7 = 0 THEN 'nowhere' WHEN page_id % 7 = 1 THEN ' ' ELSE 'w/' || page_id || '.md::H' || (page_id % 5) || '::Sub' END AS segment_id FROM pages)
SELECT call_id, CASE WHEN trim(segment_id) = '' THEN 'Error: Please provide a segment ID' WHEN place IS NULL THEN 'Error: Segment ''' || segment_id || ''' not found' ELSE 'Segment: ' || array_to_string(list_concat([file_path], section), ' > ') || chr(10) || 'Size: ~' || {TOKENS} || ' tokens' || chr(10) || chr(10) || content END AS answer
FROM c LEFT JOIN seg ON segment_id = array_to_string(list_concat([file_path], section), '::')""")
def udf05_read(spark, d):
    i = F.col("page_id")
    ident = F.when(i % 7 == 0, "nowhere").when(i % 7 == 1, " ").otherwise(F.concat(F.lit("w/"), i, F.lit(".md::H"), i % 5, F.lit("::Sub")))
    return knowledge.read_knowledge(knowledge.index(as_markdown(spark, d)), table(spark, d, "pages").select(i.alias("call_id"), ident.alias("segment_id")))


ASKED = [(0, "der und"), (1, "the the of"), (2, "zzz"), (3, " ")]
AGE = "CASE WHEN a <= 0 THEN 'today' WHEN a = 1 THEN 'yesterday' WHEN a < 7 THEN a || ' days ago' WHEN a // 7 = 1 THEN '1 week ago' WHEN a < 30 THEN (a // 7) || ' weeks ago' WHEN a // 30 = 1 THEN '1 month ago' ELSE (a // 30) || ' months ago' END"


@query("udf05_recall", "WITH bank AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS key, text AS value, doc_id % 50 AS a FROM documents), " + bm25_sql("SELECT key, key || ' ' || value AS text FROM bank", ASKED) + f""",
g AS (SELECT query_id, string_agg('[' || {AGE} || '] ' || key || ': ' || value, chr(10) ORDER BY rank) AS body FROM r JOIN bank USING (key) GROUP BY query_id)
SELECT CAST(c.query_id AS BIGINT) AS query_id, CASE WHEN trim(query) = '' THEN 'Error: Please provide a search query' ELSE coalesce(body, 'No matching memories found.') END AS answer FROM calls c LEFT JOIN g ON c.query_id = g.query_id""")
def udf05_recall(spark, d):
    i = F.col("doc_id")
    bank = documents(spark, d).select(F.lpad(i.cast("string"), 9, "0").alias("key"), F.col("text").alias("value"), (i % 50).alias("days_ago"))
    return knowledge.recall(bank, spark.createDataFrame(ASKED, "query_id long, query string"))


@query("udf05_delegate", "SELECT page_id AS call_id, 'Task delegated: read ' || url || chr(10) || 'The specialist is working on it. Result will be provided when ready.' AS answer FROM pages")
def udf05_delegate(spark, d):
    return knowledge.delegate(table(spark, d, "pages").select(F.col("page_id").alias("call_id"), F.concat(F.lit("read "), "url").alias("task")))


@query("stm04_remember_modes", """SELECT mode, answer, count(*) AS calls, CAST(any_value(stored) AS BIGINT) AS stored FROM (SELECT doc_id, unnest(['eval', 'write']) AS mode, unnest([0, (SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0) FROM documents)]) AS stored,
CASE WHEN doc_id % 3 = 0 THEN 'Error: Please provide a key' WHEN doc_id % 5 = 0 THEN 'Error: Please provide a value' ELSE 'Memory stored.' END AS answer FROM documents) GROUP BY mode, answer""")
def stm04(spark, d):
    """In eval mode nothing is written, else valid entries are appended."""
    i, path = F.col("doc_id"), workspace.fresh(spark, "bank")
    rows = documents(spark, d).select(i.alias("call_id"), F.when(i % 3 == 0, " ").otherwise(i.cast("string")).alias("key"), F.when(i % 5 == 0, "").otherwise(F.col("lang")).alias("value"))
    parts = []
    for mode, eval_mode in (("eval", True), ("write", False)):
        answers = knowledge.remember(rows, path, eval_mode)
        stored = 0 if eval_mode else readers.memory_bank(spark, path).count()
        parts.append(answers.groupBy("answer").agg(F.count("*").alias("calls")).select(F.lit(mode).alias("mode"), "answer", "calls", F.lit(stored).cast("long").alias("stored")))
    return parts[0].unionByName(parts[1])


@query("stm03_index_rebuilt", "SELECT * FROM (VALUES (0, 1, (SELECT count(*) FROM nation)), (1, 1, (SELECT count(*) FROM nation)), (2, 2, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region))) t(step, built, entries)")
def stm03(spark, d):
    """Asked twice, the index is built once; after an append it is built again."""
    path = workspace.fresh(spark, "bank")
    entry = lambda name, key: table(spark, d, name).select(F.col(key).alias("key"), F.col(key).alias("value"), F.lit(0).cast("long").alias("days_ago"))
    sinks.json_lines(entry("nation", "n_name"), path)
    bank, out = knowledge.Bank(spark, path, readers.memory_bank), []
    for step in range(3):
        if step == 2:
            sinks.json_lines(entry("region", "r_name"), path, append=True)
        out.append((step, 0, bank.entries().count()))
        out[-1] = (step, bank.built, out[-1][2])
    return spark.createDataFrame(out, "step int, built int, entries long")


@query("stm06_replayed_state", "SELECT source, doc_id, state FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS state FROM documents) WHERE doc_id % 3 = 0 OR doc_id % 10 > 6")
def stm06(spark, d):
    """A run was broken off; its pages are replayed from their stored state, the others go on from there."""
    pages = documents(spark, d).select("source", "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    add = lambda state, page: state + page["n_chars"]
    none = spark.createDataFrame([], "source string, doc_id long, state long")
    path = workspace.fresh(spark, "done")
    incremental.replay_fold(pages, none, "source", "doc_id", add, 0, "long").where("doc_id % 3 <> 0 and doc_id % 10 <= 6").write.parquet(path)
    return incremental.replay_fold(pages, spark.read.parquet(path), "source", "doc_id", add, 0, "long")


@query("stm09_stage_once", "SELECT n_nationkey, 'first' AS run FROM nation")
def stm09(spark, d):
    """A finished stage is not run again."""
    path, n = workspace.fresh(spark, "stage"), table(spark, d, "nation").select("n_nationkey")
    for run in ("first", "second"):
        out = sinks.once(spark, path, lambda run=run: n.withColumn("run", F.lit(run)))
    return out


SUITE = "['personality', 'social_reasoning', 'tool_use', 'memory_handling', 'stability', 'language', 'other'][doc_id % 7 + 1]"


@query("udf07_suite_scores", f"""WITH t AS (SELECT doc_id, {SUITE} AS suite, length(text) AS z, text FROM documents),
v AS (SELECT doc_id, suite, z, CASE WHEN suite = 'social_reasoning' THEN (1 + z % 5 + 1 + (z + 1) % 5 + 1 + (z + 2) % 5 + 1 + (z + 3) % 5) / 4.0 ELSE (1 + z % 5)::DOUBLE END AS score FROM t WHERE suite NOT IN ('stability', 'other') AND z % 17 <> 0),
u AS (SELECT doc_id, length(x) AS z FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t WHERE suite = 'stability'))
SELECT 'd' || doc_id AS prompt_id, suite, round(score, 6) AS score, CASE WHEN suite = 'social_reasoning' THEN 4 END AS subs, CASE suite WHEN 'memory_handling' THEN score >= 3 WHEN 'tool_use' THEN CASE doc_id % 4 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN false WHEN 2 THEN false END END AS passed FROM v
UNION ALL SELECT 'd' || doc_id, 'stability', round(avg((1 + z % 5 > 2)::int), 6), count(*), NULL FROM u WHERE z % 17 <> 0 GROUP BY doc_id""")
def udf07(spark, d):
    """Judges of six suites and the dispatch by suite; traces without a verdict give no row."""
    i = F.col("doc_id")
    order = ["personality", "social_reasoning", "tool_use", "memory_handling", "stability", "language", "other"]
    names = F.array(*map(F.lit, order))
    expected = F.when(i % 4 == 0, "wiki").when(i % 4 == 1, "delegate").when(i % 4 == 2, "none")
    tools = F.when(i % 2 == 0, F.array(F.lit("search_knowledge"))).otherwise(F.array(F.lit("recall")))
    traces = documents(spark, d).select(F.concat(F.lit("d"), i).alias("prompt_id"), F.element_at(names, (i % 7 + 1).cast("int")).alias("suite"), "text", F.split("text", "\n").alias("turns"), tools.alias("calls"), expected.alias("expected"))
    judge = lambda suite: agents.RubricJudge(agents.SOCIAL if suite == "social_reasoning" else ("score",))
    out = agents.score_traces(traces, judge)
    return out.select("prompt_id", "suite", F.round("score", 6).alias("score"), F.when(F.col("sub_scores").isNotNull(), F.size("sub_scores")).cast("long").alias("subs"), "passed")


@query("udf09_user_turn", "SELECT conv_id, 'Write the next user message. ' || CAST(2 + sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) || ' lines, ' || CAST(45 + sum(length(text) + CASE role WHEN 'assistant' THEN 8 ELSE 7 END) AS BIGINT) || ' characters' AS said FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def udf09(spark, d):
    c = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    talks = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return talks.select("conv_id", agents.user_turn(agents.Listing(), F.col("m"), F.lit("a reader"), F.lit("unheard of")).alias("said"))


@query("prj44_simulator_prompt", "SELECT conv_id, 'Profile: a reader' || chr(10) || 'Directive: Press harder than before.' || chr(10) || string_agg(CASE role WHEN 'assistant' THEN 'Reply: ' ELSE 'User: ' END || text, chr(10) ORDER BY turn) AS prompt FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def prj44_prompt(spark, d):
    c = table(spark, d, "conversations")
    talks = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).where(F.exists("m", lambda x: x.role.isin("user", "assistant")))
    return talks.select("conv_id", agents.simulator_prompt(F.col("m"), F.lit("a reader"), F.lit("escalate")).alias("prompt"))


@query("udf10_reflections", "SELECT doc_id AS scene_id, (1 + length(text) % 5)::DOUBLE AS score, length(text) || ' characters' AS justification FROM documents WHERE length(text) % 17 <> 0")
def udf10(spark, d):
    scenes = documents(spark, d).select(F.col("doc_id").alias("scene_id"), "text")
    return agents.reflections(scenes, agents.RubricJudge(), agents.RUBRIC).drop("raw")


class Claims:
    """Finds an added and a supported claim in every text, and one event of no known kind."""

    def __call__(self, system, messages):
        size = len(messages[-1]["content"])
        events = [("add", f"c{size % 7}", str(size)), ("support", f"c{size % 3}", "again"), ("invent", "x", "x")]
        return B.Reply(json.dumps([{"op": op, "path": "a.b", "claim_id": i, "text": t} for op, i, t in events]))


@query("udf11_claim_events", "SELECT doc_id AS scene_id, doc_id || '.' || k AS seq, op, 'a.b' AS path, claim_id, txt AS text FROM (SELECT doc_id, unnest([0, 1]) AS k, unnest(['add', 'support']) AS op, unnest(['c' || (length(text) % 7), 'c' || (length(text) % 3)]) AS claim_id, unnest([length(text)::VARCHAR, 'again']) AS txt FROM documents)")
def udf11(spark, d):
    """Scenes to ledger events; what is no event is left out."""
    scenes = documents(spark, d).select(F.col("doc_id").alias("scene_id"), "text", F.col("doc_id").alias("seq"))
    return agents.claim_events(scenes, Claims())


STAGES = ["Refine", "Synthesize", "Generalize", "Condense", "Write"]


@query("udf11_rewriters", "SELECT s AS stage, source, count(*) AS n, s || ' ' || count(*) || ' lines, ' || CAST(sum(length(lang) + 3) - 1 AS BIGINT) || ' characters' AS text FROM documents, (SELECT unnest(['Refine', 'Synthesize', 'Generalize', 'Condense', 'Write']) AS s) GROUP BY s, source")
def udf11_rewriters(spark, d):
    """Refiner, synthesizer, generalizer, condenser and document writer: one generation a group each."""
    rows = documents(spark, d).select("source", "doc_id", F.col("lang").alias("text"))
    parts = [agents.rewritten(rows, agents.Listing(), s, "source", "doc_id", "text").select(F.lit(s).alias("stage"), "source", "n", "text") for s in STAGES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Clumsy:
    """Edits well at the first try, the second or never, by the number in its instruction; later tries need the reason of the failure."""

    def __call__(self, system, messages):
        number = int(messages[0]["content"].rpartition(" ")[2])
        told = len(messages) > 1 and "0 times" in messages[-1]["content"]
        good = number % 3 == 0 or (number % 3 == 1 and told)
        return B.Reply("calm => loud" if good else "missing => x")


@query("itr06_edit_retry", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source || ' is calm' ELSE source || ' is loud' END AS profile, CAST(doc_id % 3 + 1 AS INT) AS attempts, CASE WHEN doc_id % 3 = 2 THEN '''missing'' stands there 0 times' END AS failure FROM documents")
def itr06(spark, d):
    """Edits tried again with the reason of the failure; after three failures the profile stays as it was."""
    made = agents.edited(Clumsy(), F.concat("source", F.lit(" is calm")), F.concat(F.lit("edit "), "doc_id"))
    return documents(spark, d).select("doc_id", made.alias("e")).select("doc_id", "e.*")


@query("src28_manual_prompts", f"SELECT kind || '-' || lpad(n::VARCHAR, 3, '0') AS id, kind, 'The user ' || wants AS user_summary, CASE WHEN tools = '' THEN 0 ELSE len(string_split(tools, ',')) END AS tools FROM (VALUES {values(prompts.MANUAL)}) t(kind, wants, tools), (SELECT unnest(range(1, 6)) AS n)")
def src28_manual(spark, d):
    return prompts.manual_prompts(spark).select("id", "kind", "user_summary", F.size("tools").cast("long").alias("tools"))


@query("src28_suite_prompts", f"SELECT suite || '-' || lpad(i::VARCHAR, 3, '0') || CASE WHEN v = '' THEN '' ELSE '-' || v END AS id, suite, v AS variant, e AS expected_tool_use FROM (SELECT suite, e, i, unnest(string_split(vs, ',')) AS v FROM (SELECT suite, vs, e, unnest(range(1, n + 1)) AS i FROM (VALUES {values(prompts.SUITES)}) t(suite, n, vs, e)))")
def src28_suites(spark, d):
    return prompts.suite_prompts(spark)


@query("src28_corpus_scenarios", f"SELECT part || '-' || i AS key, part, CAST(f + i * s AS INT) AS days_ago FROM (SELECT part, f, s, unnest(range(n)) AS i FROM (VALUES {values(prompts.CORPUS)}) t(part, n, f, s))")
def src28_corpus(spark, d):
    return prompts.corpus_scenarios(spark)


@query("str07_ratios", "SELECT a, b, ratio::DOUBLE AS ratio FROM (VALUES ('abcd', 'bcde', 0.75), ('', '', 1.0), ('abc', '', 0.0), ('private thread', 'private volatile', 0.666667), ('x', 'y', 0.0)) t(a, b, ratio)")
def str07(spark, d):
    """Similarity by longest common blocks, against known values."""
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("abc", ""), ("private thread", "private volatile"), ("x", "y")], "a string, b string")
    return rows.select("a", "b", F.round(consensus.similarity(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("agg20_medoids", "SELECT * FROM (VALUES ('one', 'one'), ('the cat,the cats,the bats', 'the cats'), ('a,b,c', 'a')) t(texts, medoid)")
def agg20_medoids(spark, d):
    """The text most like the others; the first of equals."""
    rows = ["one", "the cat,the cats,the bats", "a,b,c"]
    return spark.createDataFrame([(r, consensus.medoid(r.split(","))) for r in rows], "texts string, medoid string")


@query("flt09_target_pages", "SELECT source, doc_id // 50 AS page FROM documents GROUP BY ALL HAVING bool_or(lang = 'fr') OR max((n_chars % 10) / 10.0) > 0.85")
def flt09(spark, d):
    """Pages with a line of the target or one that may be."""
    pages = documents(spark, d).withColumn("page", F.floor(F.col("doc_id") / 50)).groupBy("source", "page").agg(F.bool_or(F.col("lang") == "fr").alias("target"), F.max(F.col("n_chars") % 10 / 10).alias("sure"))
    return pages.where("target or sure > 0.85").select("source", "page")


@query("flt31_target_present", "SELECT source, doc_id // 50 AS page, bool_or(lang = 'fr') AS present FROM documents GROUP BY ALL")
def flt31(spark, d):
    return documents(spark, d).withColumn("page", F.floor(F.col("doc_id") / 50)).groupBy("source", "page").agg(F.bool_or(F.col("lang") == "fr").alias("present"))


@query("flt22_missing_headers", "SELECT page_id, array_to_string(list_filter(['H1', 'Last', 'Other'], lambda h: h <> 'Last' AND h <> 'H' || (page_id % 5)), ',') AS missing FROM pages")
def flt22(spark, d):
    """Required headings that a document lacks."""
    files = as_markdown(spark, d).withColumn("page_id", F.regexp_extract("file_path", r"(\d+)", 1).cast("long"))
    need = F.array(*map(F.lit, ("H1", "Last", "Other")))
    return files.select("page_id", F.array_join(F.array_except(need, markdown.headers("content")), ",").alias("missing"))


@query("set11_condense_union", "WITH g AS (SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang, source) SELECT 'merged' AS kind, first AS id, n FROM g WHERE n > 1 UNION ALL SELECT 'kept', first, n FROM g WHERE n = 1")
def set11(spark, d):
    """A pass's working set: groups of two or more give one row, single rows go on unchanged."""
    g = documents(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    merged, kept = (g.where(c).select(F.lit(k).alias("kind"), "id", "n") for k, c in (("merged", "n > 1"), ("kept", "n = 1")))
    return merged.unionByName(kept)


@query("prj42_claim_groups", "SELECT lang AS section, string_agg('- ' || source || ' [' || CASE WHEN n - 5 > 0 THEN '+' ELSE '' END || (n - 5) || ']', chr(10) ORDER BY n DESC, source) AS lines FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def prj42(spark, d):
    """Claims of a section with their signed support, the best supported first."""
    from ..functions import text as T

    g = documents(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("- "), "source", F.lit(" "), T.signed(F.col("n") - 5))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "source", line.alias("line"))))
    return g.groupBy(F.col("lang").alias("section")).agg(F.array_join(F.transform(rows, lambda x: x.line), "\n").alias("lines"))
