"""Queries of single operators that the larger queries use only in part."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import backend as B
from ..functions import text as T
from ..operators import chat, compose, consensus, ledger, sequence
from ..sources import readers, sinks, workspace
from . import evaluation as E
from . import retrieval as R
from .base import mean_in_order, query, table


def docs(spark, d):
    return table(spark, d, "documents")


def conv(spark, d):
    return table(spark, d, "conversations")


@query("prj04_json_round_trip", "SELECT conv_id, count(*) AS n, md5(string_agg(role || text, '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def prj04(spark, d):
    """Also JSN01: nested records to JSON and back."""
    m = chat.collect_messages(conv(spark, d)).select("conv_id", F.to_json("messages").alias("j"))
    back = m.select("conv_id", F.from_json("j", "array<struct<turn:bigint,role:string,content:string>>").alias("m"))
    return back.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x.role, x.content)), "")).alias("h"))


@query("prj11_preamble", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '[User]' || chr(10) || lang ELSE '[User]' || chr(10) || lang || chr(10) || chr(10) || '[Memory]' || chr(10) || source END AS context FROM documents")
def prj11(spark, d):
    i = F.col("doc_id") % 3
    return docs(spark, d).select("doc_id", chat.preamble(F.when(i > 0, F.col("lang")), F.when(i == 2, F.col("source")).otherwise("")).alias("context"))


@query("prj13_prefix_text", "SELECT conv_id, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)) AS h FROM conversations WHERE turn <= 1 GROUP BY conv_id")
def prj13(spark, d):
    m = chat.collect_messages(conv(spark, d)).withColumn("m", F.filter("messages", lambda x: x.turn <= 1)).where(F.size("m") > 0)
    return m.select("conv_id", F.md5(chat.render(F.col("m"))).alias("h"))


@query("prj16_lines_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM documents")
def prj16(spark, d):
    """Also JSN02: a JSON array, or one JSON object a line; broken lines are left out."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.lit('[{"k": "a"}, {"k": "b"}]')).otherwise(F.lit('{"k": "a"}\n{nope\n'))
    rows = docs(spark, d).select("doc_id", raw.alias("r"))
    whole = F.from_json("r", "array<struct<k:string>>")
    lines = F.filter(F.transform(F.split("r", "\n"), lambda x: F.from_json(x, "k string")), lambda x: x.k.isNotNull())
    return rows.select("doc_id", F.size(F.when(F.ltrim("r").startswith("["), whole).otherwise(lines)).alias("n"))


@query("prj18_synonyms", "SELECT doc_id, CASE lang WHEN 'en' THEN 'Inglese' WHEN 'fr' THEN 'Francese' ELSE lang END AS name FROM documents")
def prj18(spark, d):
    names = spark.createDataFrame([("en", "Inglese"), ("fr", "Francese")], "lang string, name string")
    return docs(spark, d).join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("name", "lang").alias("name"))


@query("prj25_fact_rows", f"WITH {E.FACTS} SELECT kind, CASE WHEN kind = 'support' THEN 1 ELSE -1 END AS sign, count(*) AS n FROM f GROUP BY ALL")
def prj25(spark, d):
    """A nested ledger as signed rows."""
    nested = E.facts(spark, d).groupBy("claim_id").agg(F.collect_list(F.when(F.col("kind") == "support", F.col("scene_id"))).alias("s"), F.collect_list(F.when(F.col("kind") != "support", F.col("scene_id"))).alias("c"))
    part = lambda c, kind, sign: nested.select("claim_id", F.explode(c).alias("scene_id"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    return part("s", "support", 1).unionByName(part("c", "contradict", -1)).groupBy("kind", "sign").agg(F.count("*").alias("n"))


@query("prj37_first_header", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS name FROM pages")
def prj37(spark, d):
    text = F.concat(F.lit("intro\n# "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("\n# other"))
    return table(spark, d, "pages").select("page_id", F.regexp_extract(text, r"(?m)^# (.*)$", 1).alias("name"))


@query("prj40_result_text", "SELECT source, string_agg('- ' || doc_id || ': ' || CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END, chr(10) ORDER BY doc_id) AS results FROM documents GROUP BY source")
def prj40(spark, d):
    rows = docs(spark, d).withColumn("line", F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(": "), T.truncate("text", 50)))
    return rows.groupBy("source").agg(sequence.ordered_text("doc_id", "line").alias("results"))


@query("prj41_story_context", "WITH a AS (SELECT conv_id, list(CAST(turn AS VARCHAR) ORDER BY turn) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'So far: ' || array_to_string(l[1:2], '; ') || chr(10) ELSE '' END || 'Events: ' || len(l) AS context FROM a")
def prj41(spark, d):
    a = chat.collect_messages(conv(spark, d)).withColumn("l", F.transform("messages", lambda m: m.turn.cast("string")))
    far = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("So far: "), F.array_join(F.slice("l", 1, 2), "; ")))
    return a.select("conv_id", F.concat_ws("\n", far, F.concat(F.lit("Events: "), F.size("l").cast("string"))).alias("context"))


@query("flt04_relevant", f"SELECT entry_id FROM ({R.ENTRIES}) WHERE list_has_any(tags, ['fr', 'src7']) AND character = 'a'")
def flt04(spark, d):
    """Tag overlap, and the character where the profile has one; empty tags are never relevant."""
    one = spark.createDataFrame([(0, "a", ["fr", "src7"]), (1, "a", [])], "profile_id long, character string, tags array<string>")
    return compose.relevant(one, R.entries(spark, d)).select("entry_id")


@query("flt05_excluded_pairs", "SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src1') AND NOT (lang = 'fr' AND source = 'src2')")
def flt05(spark, d):
    pairs = spark.createDataFrame([("en", "src1"), ("fr", "src2")], "lang string, source string")
    return compose.excluding(docs(spark, d), F.broadcast(pairs), ["lang", "source"]).select("doc_id")


@query("flt10_low_confidence", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_discount < 0.02) AND avg(l_discount) <= 0.05")
def flt10(spark, d):
    """Also FLT09 and FLT31."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") < 0.02).alias("low"), mean_in_order("l_discount").alias("m"))
    return g.where(F.col("low") & (F.col("m") <= 0.05)).select("l_orderkey")


@query("flt12_spurious_lines", "SELECT l_orderkey, count(*) < 2 AS spurious, count(*) > 6 AS review FROM lineitem GROUP BY l_orderkey")
def flt12(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return g.select("l_orderkey", (F.col("n") < 2).alias("spurious"), (F.col("n") > 6).alias("review"))


@query("flt14_set_equality", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING list_sort(list_distinct(list(role))) = ['assistant', 'user']")
def flt14(spark, d):
    s = conv(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("s"))
    return s.where(F.col("s") == F.array(F.lit("assistant"), F.lit("user"))).select("conv_id")


@query("flt21_required_sections", "SELECT page_id, array_to_string(list_filter(['<h1>', '<h2>', '<table>', '<footer>'], lambda t: NOT contains(html, t)), ',') AS missing FROM pages")
def flt21(spark, d):
    """Also FLT22."""
    need = F.array(*map(F.lit, ["<h1>", "<h2>", "<table>", "<footer>"]))
    return table(spark, d, "pages").select("page_id", F.array_join(F.filter(need, lambda t: ~F.contains("html", t)), ",").alias("missing"))


@query("flt30_evidence_by_trait", f"WITH {E.FACTS} SELECT scene_id, count(*) AS n FROM f WHERE kind = 'contradict' AND scene_id % 5 = 1 GROUP BY scene_id")
def flt30(spark, d):
    return E.facts(spark, d).where((F.col("kind") == "contradict") & (F.col("scene_id") % 5 == 1)).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("agg08_language_mean", f"WITH {E.SCORED} SELECT round(coalesce(avg(score), 0.0), 6) AS mean_score, count(*) AS n FROM s WHERE suite = 'language'")
def agg08(spark, d):
    from ..operators.evaluation import mean

    return E.scored(spark, d).where("suite = 'language'").agg(F.round(mean("score"), 6).alias("mean_score"), F.count("*").alias("n"))


@query("agg25_run_merge", "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) SELECT user_id, min(event_id) AS first, round(avg(value), 6) AS confidence FROM r GROUP BY user_id, run")
def agg25(spark, d):
    r = sequence.runs(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.round(F.avg("value"), 6).alias("confidence")).drop("run")


@query("agg37_issue_rollup", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS ids, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS langs FROM documents GROUP BY source")
def agg37(spark, d):
    g = docs(spark, d).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("i"), F.array_sort(F.collect_set("lang")).alias("l"))
    return g.select("source", F.array_join(F.transform("i", lambda x: x.cast("string")), " ").alias("ids"), F.array_join("l", " ").alias("langs"))


@query("top17_first_quotes", "SELECT source, array_to_string((list(CAST(doc_id AS VARCHAR) ORDER BY doc_id))[1:2], ',') AS quotes FROM documents GROUP BY source")
def top17(spark, d):
    g = docs(spark, d).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("q"))
    return g.select("source", F.array_join(F.transform(F.slice("q", 1, 2), lambda x: x.cast("string")), ",").alias("quotes"))


@query("top08_issue_order", "SELECT l_orderkey, l_linenumber, CAST(replace(l_orderkey || '/' || l_linenumber, '/', '.') AS DOUBLE) AS key FROM lineitem")
def top08(spark, d):
    name = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.replace(name, F.lit("/"), F.lit(".")).cast("double").alias("key"))


@query("set04_complement", f"SELECT list_has_any(tags, ['fr']) AS relevant, count(*) AS n FROM ({R.ENTRIES}) GROUP BY 1")
def set04(spark, d):
    return R.entries(spark, d).groupBy(F.arrays_overlap("tags", F.array(F.lit("fr"))).alias("relevant")).agg(F.count("*").alias("n"))


@query("set09_distinct_sorted", "SELECT DISTINCT source FROM documents WHERE n_chars <= 300 ORDER BY source")
def set09(spark, d):
    return docs(spark, d).where("n_chars <= 300").select("source").distinct().orderBy("source")


@query("set10_merge_scored", "SELECT doc_id, 1 AS round FROM labels UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set10(spark, d):
    old = table(spark, d, "labels").select("doc_id")
    new = sinks.resume(docs(spark, d).select("doc_id"), old, ["doc_id"])
    return old.withColumn("round", F.lit(1)).unionByName(new.withColumn("round", F.lit(2)))


@query("src14_optional_summary", "SELECT s AS issue, CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS events FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem)")
def src14(spark, d):
    issues = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("issue")).distinct()
    summaries = issues.where("issue % 2 = 0").select("issue", F.array(F.lit("e")).alias("key_events"))
    return readers.optional_summaries(issues, summaries).select("issue", F.size("key_events").alias("events"))


@query("src26_image_listing", "SELECT 'a.jpg' AS name UNION ALL SELECT 'b.jpeg'")
def src26(spark, d):
    """Files of both endings, written here as text."""
    root = workspace.fresh(spark, "img")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("a.jpg", "b.jpeg", "c.png"):
        file = path(f"{root}/{name}")
        out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file)
        out.write(255)
        out.close()
    return readers.images(spark, root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


@query("snk14_format_migration", "SELECT doc_id, 2 AS version, lang || '/' || source AS origin FROM documents")
def snk14(spark, d):
    """Records of an old layout, written in the new one beside them."""
    old, new = workspace.fresh(spark, "v1"), workspace.fresh(spark, "v2")
    sinks.json_lines(docs(spark, d).select("doc_id", "lang", "source"), old)
    rows = readers.strict(spark, old, "doc_id long, lang string, source string")
    sinks.json_lines(rows.select("doc_id", F.lit(2).alias("version"), F.concat_ws("/", "lang", "source").alias("origin")), new)
    return readers.strict(spark, new, "doc_id long, version int, origin string")


@query("snk18_relayout", "SELECT doc_id, 'out/' || lang || '/' || source || '.json' AS path FROM documents")
def snk18(spark, d):
    path = F.concat_ws("", F.lit("in/"), "source", F.lit("__"), "lang", F.lit(".json"))
    return docs(spark, d).select("doc_id", sinks.relayout(path, r"^in/(.*)__(.*)\.json$", "out/$2/$1.json").alias("path"))


@query("stm02_failed_rows", "SELECT doc_id, doc_id % 7 = 0 AS pending FROM documents")
def stm02(spark, d):
    """Rows that fail are not written, so they are pending still."""
    path = workspace.fresh(spark, "scored")
    sinks.run_resumable(docs(spark, d).select("doc_id"), path, ["doc_id"], lambda df: df.where("doc_id % 7 <> 0"))
    done = spark.read.parquet(path).withColumn("ok", F.lit(True))
    return docs(spark, d).join(done, "doc_id", "left").select("doc_id", F.col("ok").isNull().alias("pending"))


@query("udf04_tool_schema", """SELECT 'search_knowledge' AS name, '{"name": "search_knowledge", "description": "Segments that fit the keywords best.", "parameters": {"type": "object", "properties": {"keywords": {"type": "string"}, "max_results": {"type": "integer"}}, "required": ["keywords"], "additionalProperties": false}}' AS schema""")
def udf04(spark, d):
    """Also UDF03 and JSN03: schemas of the registered tools."""
    import json

    def search_knowledge(keywords: str, max_results: int = 5) -> str:
        """Segments that fit the keywords best."""
        return keywords

    return spark.createDataFrame([(s["name"], json.dumps(s)) for s in B.Tools({"search_knowledge": search_knowledge}).schemas()], "name string, schema string")


@query("udf06_ledger_tools", "SELECT 1 AS claim_id, 'new' AS text, 1 AS support UNION ALL SELECT 2, 'two', -1")
def udf06(spark, d):
    """A ledger of two claims after a few tool calls; the repeated and the misplaced one are refused."""
    empty = spark.createDataFrame([], "claim_id long, text string, path string, scope string")
    book = ledger.Ledger(empty, spark.createDataFrame([], "claim_id long, scene_id long, kind string, quote string, seq long"))
    book = book.add(1, "one", "identity/a").add(2, "two", "history/b").add(3, "bad", "nowhere/c")
    book = book.evidence(1, 7, "support", 0, "q").evidence(1, 7, "support", 1, "again").evidence(2, 7, "contradict", 2).evidence(9, 1, "support", 3).refined(1, "new")
    return book.listed().select(F.col("claim_id").cast("int").alias("claim_id"), "text", F.col("support").cast("int").alias("support"))


@query("str03_encoder_count", "SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: (length(x) + 3) // 4)), 0) AS BIGINT) AS tokens FROM documents")
def str03(spark, d):
    """Counts by an injected encoder; here one that cuts words into pieces of four characters."""
    encode = lambda t: [w[i : i + 4] for w in t.split() for i in range(0, len(w), 4)]
    return docs(spark, d).select("doc_id", T.bpe_count("text", encode).alias("tokens"))


@query("dat01_run_names", "SELECT 1 AS rows, true AS named")
def dat01(spark, d):
    return spark.range(1).select(T.stamp().alias("s")).agg(F.count("*").cast("int").alias("rows"), F.bool_and(F.col("s").rlike(r"^\d{8}-\d{6}$")).alias("named"))


@query("mth01_clamp_blend", "SELECT event_id, round(greatest(0.0, least(100.0, value * 2 - 50)), 6)::DOUBLE AS clamped, CAST(floor(value / 7) AS BIGINT) AS step FROM events")
def mth01(spark, d):
    """Also MTH03."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v * 2 - 50)), 6).alias("clamped"), F.floor(v / 7).alias("step"))


@query("arr02_slices", "SELECT conv_id, array_to_string(list_reverse(l), ',') AS back, l[2] AS second FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def arr02(spark, d):
    """Also ARR01 and ARR04."""
    m = chat.collect_messages(conv(spark, d)).withColumn("l", F.transform("messages", lambda x: x.role))
    return m.select("conv_id", F.array_join(F.reverse("l"), ",").alias("back"), F.try_element_at("l", F.lit(2)).alias("second"))


@query("map03_counter_merge", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS calls FROM documents GROUP BY source")
def map03(spark, d):
    """Also MAP01 and MAP02: maps of counters added by key."""
    usage = F.create_map(F.lit("chars"), F.col("n_chars"), F.lit("calls"), F.lit(1).cast("long"))
    sums = docs(spark, d).select("source", F.explode(usage).alias("k", "n")).groupBy("source", "k").agg(F.sum("n").alias("n"))
    m = sums.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("source", F.try_element_at("m", F.lit("chars")).alias("chars"), F.try_element_at("m", F.lit("calls")).alias("calls"))


@query("jon08_flag_recompute", "SELECT d.doc_id, coalesce(l.quality = 1, n_chars > 3000) AS present FROM documents d LEFT JOIN labels l USING (doc_id)")
def jon08(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 1, F.col("n_chars") > 3000).alias("present"))


@query("win14_mean_position")
def win14(spark, d):
    """Clusters in the order of their members' mean position."""
    from .relational import takes

    rank = F.row_number().over(W.partitionBy("page").orderBy("pos"))
    return consensus.consensus(takes(spark, d)).select("page", rank.alias("rank"), "text", "members")
