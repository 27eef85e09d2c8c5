"""Queries of scans, sinks, joins, set operations, Markdown, consensus and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import consensus, markdown, sequence
from ..sources import readers, sinks, workspace
from ..streaming import incremental
from .base import mean_in_order, query, table


def documents(spark, d):
    return table(spark, d, "documents")


def conversations(spark, d):
    return table(spark, d, "conversations")


def written(spark, df, label="rows", append_twice=False):
    path = workspace.fresh(spark, label)
    sinks.json_lines(df, path)
    if append_twice:
        sinks.json_lines(df, path, append=True)
    return path


@query("src04_memory_bank", "SELECT CAST(doc_id AS VARCHAR) AS key, text AS value, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS days_ago FROM documents")
def src04(spark, d):
    """Strict JSON lines, written and read back; a missing age is 0."""
    rows = documents(spark, d).select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50).alias("days_ago"))
    return readers.memory_bank(spark, written(spark, rows))


@query("src05_suite_partitions", "SELECT 'p-' || doc_id AS prompt_id, lang AS suite FROM documents WHERE lang IN ('en', 'fr')")
def src05(spark, d):
    """Also SRC07 and SNK04: a folder for each suite; the filter prunes partitions."""
    path = workspace.fresh(spark, "suites")
    sinks.by_value(documents(spark, d).select(F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("prompt_id"), F.col("lang").alias("suite")), path, "suite")
    return readers.by_suite(spark, path, "prompt_id string", ["en", "fr"]).select("prompt_id", "suite")


@query("src06_last_wins", "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def src06(spark, d):
    """Also SRC11, SRC19 and MAP02."""
    return readers.last_wins(documents(spark, d), "source", "doc_id").select("source", "doc_id", "n_chars")


@query("src08_tolerant_ids", "SELECT DISTINCT 'p-' || (doc_id // 2) AS id FROM documents WHERE doc_id % 5 <> 0")
def src08(spark, d):
    """Also SRC09 and SRC10: corrupt lines and lines without the nested id are passed over."""
    i = F.col("doc_id")
    line = F.when(i % 5 == 0, F.when(i % 2 == 0, F.lit('{"score": {"trace_id": "p-')).otherwise(F.lit('{"score": {}}'))).otherwise(F.concat(F.lit('{"score": {"trace_id": "p-'), F.floor(i / 2).cast("string"), F.lit('"}}')))
    path = workspace.fresh(spark, "ids")
    documents(spark, d).select(line.alias("value")).write.text(path)
    return readers.tolerant_ids(spark, path, "score.trace_id")


@query("src12_page_numbers", "SELECT doc_id, source AS issue, doc_id % 100 AS page_num FROM documents")
def src12(spark, d):
    """Also SRC20 and SNK18: issue and page number from paths."""
    path = F.concat(F.lit("out/"), F.col("source"), F.lit("/page_"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"), F.lit(".json"))
    moved = sinks.relayout(path, "^out/", "in/")
    return readers.page_numbers(documents(spark, d).select("doc_id", moved.alias("path"))).select("doc_id", "issue", "page_num")


@query("src18_csv_json_cells", "SELECT doc_id, lang, text, text AS plain FROM documents")
def src18(spark, d):
    """Quoted CSV with whole texts in a JSON cell and in a plain one of many lines."""
    path = workspace.fresh(spark, "csv")
    sinks.csv_json(documents(spark, d).select("doc_id", F.struct("lang", "text").alias("cell"), F.col("text").alias("plain")), path)
    return readers.csv_json(spark, path, {"cell": "lang string, text string"}, "doc_id long, cell string, plain string").select("doc_id", "cell.*", "plain")


@query("src23_parquet_round_trip", "SELECT doc_id, text FROM documents WHERE lang = 'de'")
def src23(spark, d):
    """Also SNK08."""
    path = workspace.fresh(spark, "dataset")
    documents(spark, d).where("lang = 'de'").select("doc_id", "text").write.parquet(path)
    return spark.read.parquet(path)


@query("src25_category_tree", "WITH RECURSIVE t AS (SELECT r_name || '/' || n_name AS path, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT path || '/' || s_name, s_name FROM t JOIN nation ON n_name = title JOIN supplier ON s_nationkey = n_nationkey) SELECT * FROM t")
def src25(spark, d):
    n, r, s = (table(spark, d, x) for x in ("nation", "region", "supplier"))
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    edges = edges.unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child")))
    return readers.category_tree(edges, "ASIA")


@query("snk02_append", "SELECT doc_id, count(*) * 2 AS n FROM documents GROUP BY doc_id")
def snk02(spark, d):
    """Also SNK17."""
    path = written(spark, documents(spark, d).select("doc_id"), append_twice=True)
    return readers.strict(spark, path, "doc_id long").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("snk03_fan_out", "SELECT 'all' AS sink, count(*) AS n FROM labels UNION ALL SELECT 'passing', count(*) FILTER (quality = 1) FROM labels")
def snk03(spark, d):
    a, b = workspace.fresh(spark, "all"), workspace.fresh(spark, "passing")
    sinks.fan_out(table(spark, d, "labels"), a, b, "quality = 1")
    count = lambda p, name: spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n")
    return count(a, "all").unionByName(count(b, "passing"))


@query("snk10_versions", "SELECT n_nationkey, 4 AS version FROM nation WHERE n_nationkey <= 4")
def snk10(spark, d):
    path = workspace.fresh(spark, "versions")
    for v in range(5):
        sinks.version(table(spark, d, "nation").where(F.col("n_nationkey") <= v).select("n_nationkey"), path, v)
    return sinks.latest(spark, path).select("n_nationkey", F.col("version").cast("int").alias("version"))


@query("snk12_rollback", "SELECT event_id FROM events WHERE event_id <= 500")
def snk12(spark, d):
    return sinks.rollback(table(spark, d, "events"), "event_id", 500).select("event_id")


@query("snk15_id_migration", "SELECT o_orderkey AS old_id, o_orderkey || '-' || rn AS new_id FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn > 0")
def snk15(spark, d):
    """Also SNK14: ids of later members of a base get the scene index."""
    from ..operators import sequence

    o = sequence.scene_index(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).where("scene_index > 0")
    return o.select(F.col("o_orderkey").alias("old_id"), F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("scene_index").cast("string")).alias("new_id"))


@query("snk16_review_queue", "SELECT doc_id, '{\"image\":' || doc_id || ',\"ocr\":\"' || lang || '\"}' AS item FROM documents")
def snk16(spark, d):
    return documents(spark, d).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("image"), F.col("lang").alias("ocr"))).alias("item"))


@query("jon01_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def jon01(spark, d):
    """Also JON02, JON04, JON12 and STM01."""
    done = table(spark, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.resume(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("jon03_pending_composite", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.role = 'user' AND x.conv_id = c.conv_id AND x.turn = c.turn)")
def jon03(spark, d):
    c = conversations(spark, d)
    return sinks.resume(c.select("conv_id", "turn"), c.where("role = 'user'"), ["conv_id", "turn"])


@query("jon05_trace_prompt", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jon05(spark, d):
    """Also JON06: a missing prompt is allowed; the planner broadcasts a small side by itself."""
    return documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("jon07_review_override", "SELECT doc_id, CASE WHEN quality = 1 THEN 'reviewed' ELSE source END AS line, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0")
def jon07(spark, d):
    """Also JON08: an empty review deletes its page."""
    pages = documents(spark, d).select(F.col("doc_id").alias("page"), F.array("source").alias("lines"), F.lit(0.5).alias("confidence"))
    reviews = table(spark, d, "labels").select(F.col("doc_id").alias("page"), F.when(F.col("quality") == 1, F.array(F.lit("reviewed"))).otherwise(F.array().cast("array<string>")).alias("lines"))
    return consensus.with_reviews(pages, reviews).select(F.col("page").alias("doc_id"), F.col("lines")[0].alias("line"), "confidence")


@query("jon09_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def jon09(spark, d):
    """Also JON10."""
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("jon11_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jon11(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("jon13_event_position", "SELECT doc_id, coalesce(list_position(['src1', 'src5', 'src9'], trim('\"' || source || '\"', '\"')), 0) - 1 AS pos FROM documents")
def jon13(spark, d):
    """First match of an unquoted text in a list, -1 if there is none."""
    events = F.array(F.lit("src1"), F.lit("src5"), F.lit("src9"))
    return documents(spark, d).select("doc_id", (F.array_position(events, T.strip_quotes(F.concat(F.lit('"'), "source", F.lit('"')))) - 1).cast("int").alias("pos"))


@query("jon20_presence_overrides", "SELECT source, array_to_string(list_sort(list_distinct(list_filter(list(lang) || ['it'], lambda x: x <> 'de'))), ',') AS present FROM documents GROUP BY source")
def jon20(spark, d):
    s = documents(spark, d).groupBy("source").agg(F.collect_set("lang").alias("l"))
    return s.select("source", F.array_join(F.array_sort(F.array_except(F.array_union("l", F.array(F.lit("it"))), F.array(F.lit("de")))), ",").alias("present"))


@query("jon21_sources_or_all", "SELECT source, count(*) FILTER (doc_id IN (1, 2, 3, 4)) AS named, CASE WHEN count(*) FILTER (doc_id IN (1, 2, 3, 4)) > 0 THEN count(*) FILTER (doc_id IN (1, 2, 3, 4)) ELSE count(*) END AS used FROM documents GROUP BY source")
def jon21(spark, d):
    s = documents(spark, d).groupBy("source").agg(F.collect_list("doc_id").alias("ids"))
    named = F.filter("ids", lambda i: i.isin(1, 2, 3, 4))
    return s.select("source", F.size(named).cast("long").alias("named"), F.size(F.when(F.size(named) > 0, named).otherwise(F.col("ids"))).cast("long").alias("used"))


@query("set01_union_all", "SELECT c_custkey AS id, 'customer' AS origin FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part")
def set01(spark, d):
    """Also SET02, SET03 and SET10."""
    part = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"), F.lit(t).alias("origin"))
    return part("customer", "c_custkey").unionByName(part("supplier", "s_suppkey")).unionByName(part("part", "p_partkey"))


@query("flt24_duplicate_ids", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 5")
def flt24(spark, d):
    return conversations(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 5")


@query("flt11_quality_pages", "SELECT l_orderkey, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_orderkey HAVING avg(l_discount) > 0.06 AND count(*) FILTER (l_returnflag = 'R') > 2")
def flt11(spark, d):
    """Also FLT09, FLT10, FLT12 and FLT31: group predicates."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(mean_in_order("l_discount").alias("mean"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    return g.where("mean > 0.06 and hits > 2").select("l_orderkey", F.round("mean", 6).alias("mean")).orderBy(F.desc("mean"))


@query("flt15_short_dialogues", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def flt15(spark, d):
    return conversations(spark, d).groupBy("conv_id").agg(F.collect_list("turn").alias("t")).where(F.size("t") > 1).select("conv_id")


@query("flt29_unreviewed", "SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def flt29(spark, d):
    return documents(spark, d).where("source = 'src3'").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("flt23_reduction_guard", "SELECT user_id, event_id, coalesce(value < 0.5 * lag(value) OVER (PARTITION BY user_id ORDER BY event_id), false) AS shrunk FROM events")
def flt23(spark, d):
    from pyspark.sql.window import Window as W

    before = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.col("value") < 0.5 * before, F.lit(False)).alias("shrunk"))


@query("agg21_line_confidence", "SELECT l_orderkey, l_linenumber, round(0.6 * l_discount + 0.4 * l_tax, 6) AS confidence, round(l_discount / 0.1, 6) AS normalized, CASE WHEN l_tax * 1000 > 60 THEN 60.0 ELSE l_tax * 1000 END AS clamped FROM lineitem")
def agg21(spark, d):
    """Also PRJ24 and MTH01."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(0.6 * F.col("l_discount") + 0.4 * F.col("l_tax"), 6).alias("confidence"), F.round(consensus.normalized_confidence(F.col("l_discount"), F.lit(0.1)), 6).alias("normalized"), F.greatest(F.lit(0.0), F.least(F.col("l_tax") * 1000, F.lit(60.0))).alias("clamped"))


@query("agg22_target_share", "SELECT l_orderkey, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS share FROM lineitem GROUP BY l_orderkey")
def agg22(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("share"))
    return a


@query("agg19_mode", "SELECT source, arg_max(lang, (n, -first)) AS lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) GROUP BY source")
def agg19(spark, d):
    g = documents(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


@query("agg23_conversation_scores", "SELECT conv_id, 3 * max((role = 'user')::int) + 3 * max((role = 'assistant')::int) - max((role NOT IN ('user', 'assistant'))::int) AS character_score, count(*) AS pages, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY conv_id")
def agg23(spark, d):
    c = conversations(spark, d).groupBy("conv_id").agg(F.collect_set("role").alias("r"), F.count("*").alias("pages"), F.round(F.avg(F.length("text")), 6).alias("mean"))
    want = F.array(F.lit("user"), F.lit("assistant"))
    return c.select("conv_id", (3 * F.size(F.array_intersect("r", want)) - F.size(F.array_except("r", want))).alias("character_score"), "pages", "mean")


@query("agg36_scene_index", "SELECT conv_id, count(*) AS lines, count(*) FILTER (role = 'assistant') AS own FROM conversations GROUP BY conv_id")
def agg36(spark, d):
    """Also AGG37."""
    c = conversations(spark, d).groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return c.select("conv_id", F.size("r").cast("long").alias("lines"), F.size(F.filter("r", lambda x: x == "assistant")).cast("long").alias("own"))


@query("prj38_fog_of_war", "SELECT event_id, len(list_filter(json_keys(props), lambda k: k <> 'hidden_goal')) AS known FROM events")
def prj38(spark, d):
    """Maps without their hidden keys."""
    m = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "hidden_goal")
    return table(spark, d, "events").select("event_id", F.size(m).cast("long").alias("known"))


@query("prj03_visual_cues", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS cues FROM documents")
def prj03(spark, d):
    return documents(spark, d).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long").alias("cues"))


@query("prj39_scene_view", "SELECT conv_id, count(DISTINCT role) || ' speakers: ' || string_agg(DISTINCT role, ', ' ORDER BY role) AS view FROM conversations GROUP BY conv_id")
def prj39(spark, d):
    """Also PRJ04, PRJ40 and PRJ41: ordered renderings; the set is sorted."""
    c = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"))
    return c.select("conv_id", F.concat(F.size("r").cast("string"), F.lit(" speakers: "), F.array_join("r", ", ")).alias("view"))


def as_markdown(spark, d):
    """Pages as Markdown: paragraphs under ## and ### headings."""
    body = F.concat(F.lit("intro "), F.col("url"), F.lit("\n## H"), (F.col("page_id") % 5).cast("string"), F.lit("\n"), F.col("url"), F.lit("\n### Sub\ntext of "), F.col("page_id").cast("string"), F.lit("\n## Empty\n## Last\n\n"))
    return table(spark, d, "pages").select(F.concat(F.lit("w/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), body.alias("content"))


@query("prj30_segments", """WITH p AS (SELECT page_id, url, 'w/' || page_id || '.md' AS f FROM pages)
SELECT f AS file_path, f AS segment_id, 1 AS level, 'intro ' || url AS content FROM p UNION ALL
SELECT f, f || '::H' || (page_id % 5), 2, url FROM p UNION ALL SELECT f, f || '::H' || (page_id % 5) || '::Sub', 3, 'text of ' || page_id FROM p UNION ALL SELECT f, f || '::Last', 2, '' FROM p""")
def prj30(spark, d):
    """Also PRJ33: a heading without lines gives no segment, blank lines give an empty one."""
    return markdown.segments(as_markdown(spark, d)).select("file_path", "segment_id", F.col("level").cast("int").alias("level"), "content")


@query("prj35_headers", "SELECT 'w/' || page_id || '.md' AS file_path, 'H' || (page_id % 5) || ',Empty,Last' AS headers FROM pages")
def prj35(spark, d):
    """Also PRJ37."""
    return as_markdown(spark, d).select("file_path", F.array_join(markdown.headers("content"), ",").alias("headers"))


@query("prj32_compact")
def prj32(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return markdown.compact(lines, "doc_id", "pos", "line", 50, 800)


@query("prj45_line_edits", """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
f AS (SELECT doc_id, count(*) AS n FROM l JOIN (SELECT doc_id AS d2, line AS find FROM l WHERE line_no = 1) e ON doc_id = d2 AND lower(trim(line)) = lower(trim(find)) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN f.n = 1 AND line_no = 1 AND l.doc_id % 2 = 0 THEN 'new' ELSE line END AS line, row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) - 1 AS line_no FROM l LEFT JOIN f USING (doc_id) WHERE NOT (coalesce(f.n, 0) = 1 AND line_no = 1 AND l.doc_id % 2 = 1)""")
def prj45(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    edits = lines.where("line_no = 1").select("doc_id", F.col("line").alias("find"), F.when(F.col("doc_id") % 2 == 0, "replace").otherwise("delete").alias("op"), F.lit("new").alias("put"))
    return markdown.edit_lines(lines, edits)


def takes(spark, d):
    """Three noisy readings of all lines of every document: the second misreads the speaker, the third drops a line."""
    lines = documents(spark, d).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    three = lines.withColumn("take", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("not (take = 2 and pos = 3)")
    who = F.when((F.col("take") == 1) & (F.col("pos") == 1), "other").otherwise(F.concat(F.lit("c"), (F.col("pos") % 2).cast("string")))
    return three.select("page", "take", "pos", who.alias("character"), F.concat("text", F.lit(" said the one")).alias("text"), (F.lit(0.5) + F.col("take") / 10).alias("confidence"))


@query("jon18_consensus")
def jon18(spark, d):
    """Also AGG19-AGG21, STR07 and WIN14: greedy clusters, mode, medoid, confidence."""
    out = consensus.consensus(takes(spark, d))
    return out.withColumns({"confidence": F.round("confidence", 6), "match_confidence": F.round("match_confidence", 6)})


@query("agg20_similarity")
def agg20(spark, d):
    """Each whole text against the same without its first ten characters."""
    t = documents(spark, d).select("doc_id", F.col("text").alias("a"), F.expr("substring(text, 11)").alias("b"))
    return t.select("doc_id", F.round(consensus.similarity(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("stm01_incremental", "SELECT doc_id AS id, lang FROM documents WHERE doc_id % 10 <> 0")
def stm01(spark, d):
    """Also STM02 and STM09: two runs over growing input, rows that fail stay out."""
    root = workspace.fresh(spark, "stream")
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "lang")
    for part in (rows.where("id % 2 = 0"), rows):
        sinks.json_lines(part, f"{root}/in", append=True)
        incremental.drain(spark, f"{root}/in", "id long, lang string", f"{root}/out", f"{root}/state", lambda b: b.where("id % 10 <> 0"))
    return spark.read.parquet(f"{root}/out")


@query("stm05_conversation_state", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies, bool_or(role = 'assistant') AS kept FROM conversations WHERE text <> '' GROUP BY conv_id")
def stm05(spark, d):
    """Also STM06 and UDF02: per-key state over a stream; the last state of each conversation."""
    root = workspace.fresh(spark, "talk")
    conversations(spark, d).write.parquet(f"{root}/in")
    stream = incremental.conversation_states(spark.readStream.schema(conversations(spark, d).schema).parquet(f"{root}/in"))
    put = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return readers.last_wins(spark.read.parquet(f"{root}/out"), "conv_id", "batch").drop("batch")


@query("stm08_world_state", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stm08(spark, d):
    """Also STM03 and STM04: state is a fold of the log."""
    return incremental.replay(table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


@query("events_windows", "SELECT CAST(ts::date AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_windows(spark, d):
    """A Spark built-in, not a reference operator."""
    return incremental.event_windows(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("top15_limit_before_anti", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def top15(spark, d):
    first = documents(spark, d).select("doc_id").orderBy("doc_id").limit(100)
    return first.join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("top09_locality_sort", "SELECT doc_id, source FROM documents")
def top09(spark, d):
    """Physical order only: equal prefixes lie together."""
    return documents(spark, d).select("doc_id", "source").repartitionByRange("source").sortWithinPartitions("source")


@query("arr03_batches", "SELECT source, (rn - 1) // 5 AS batch, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY ALL")
def arr03(spark, d):
    rows = sequence.numbered(documents(spark, d).select("source", "doc_id"), "source", "doc_id", "rn")
    return rows.select("source", F.floor((F.col("rn") - 1) / 5).alias("batch")).groupBy("source", "batch").agg(F.count("*").alias("n"))
