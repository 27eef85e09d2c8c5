"""Queries of evaluation and of the claim ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, evaluation, ledger
from ..functions import text as T
from .base import query, table

SUITES = ["personality", "social", "tools", "memory", "stability", "language"]
SCORED = """s AS (SELECT d.doc_id, ['personality', 'social', 'tools', 'memory', 'stability', 'language', 'other'][d.doc_id % 7 + 1] AS suite, 'p-' || d.doc_id AS prompt_id,
1.0::DOUBLE + (d.n_chars % 41) / 10.0::DOUBLE AS score, CASE l.toxic WHEN 1 THEN false WHEN 0 THEN true END AS pass, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"""


def scored(spark, d):
    suite = F.element_at(F.array(*map(F.lit, [*SUITES, "other"])), (F.col("doc_id") % 7 + 1).cast("int"))
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    score = F.lit(1.0) + (F.col("n_chars") % 41) / F.lit(10.0)
    subs = F.map_from_arrays(
        F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: F.concat(F.lit("turn_"), i.cast("string"))),
        F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: ((F.col("n_chars") + i) % 5 + 1).cast("double")),
    )
    return joined.select("doc_id", suite.alias("suite"), F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("prompt_id"), score.alias("score"), (F.col("toxic") == 0).alias("pass"), "n_chars", subs.alias("sub_scores"), F.col("doc_id").alias("seq"))


@query("agg01_suite_report", f"WITH {SCORED} SELECT suite, round(coalesce(avg(score), 0.0), 6) AS mean_score, count(*) AS n FROM s WHERE suite <> 'other' GROUP BY suite")
def agg01(spark, d):
    """Also AGG08: the language suite is a plain mean."""
    return evaluation.report(scored(spark, d), SUITES).withColumn("mean_score", F.round("mean_score", 6))


@query("agg02_empty_mean", "SELECT coalesce(avg(score), 0.0) AS mean, count(*) AS n FROM (SELECT n_chars::DOUBLE AS score FROM documents WHERE doc_id < 0)")
def agg02(spark, d):
    return scored(spark, d).where("doc_id < 0").agg(evaluation.mean("score").alias("mean"), F.count("*").alias("n"))


@query("agg03_score_histogram", f"WITH {SCORED} SELECT CAST(trunc(score) AS BIGINT) AS bucket, count(*) AS n FROM s WHERE suite = 'personality' GROUP BY 1")
def agg03(spark, d):
    return evaluation.personality(scored(spark, d).where("suite = 'personality'"))


@query("agg04_dimension_means", "SELECT 'turn_' || i AS dimension, round(avg(((n_chars + i) % 5 + 1)::DOUBLE), 6) AS mean FROM (SELECT n_chars, unnest(generate_series(0, doc_id % 4)) AS i FROM documents) GROUP BY i")
def agg04(spark, d):
    return evaluation.dimension_means(scored(spark, d)).withColumn("mean", F.round("mean", 6))


@query("agg05_tool_accuracy", f"WITH {SCORED} SELECT round(avg(score), 6) AS mean_score, count(*) AS n, round(coalesce(avg(pass::int), 0.0), 6) AS accuracy FROM s WHERE suite = 'tools'")
def agg05(spark, d):
    t = evaluation.tool_use(scored(spark, d).where("suite = 'tools'"))
    return t.select(F.round("mean_score", 6).alias("mean_score"), "n", F.round("accuracy", 6).alias("accuracy"))


@query("agg06_memory_handling", f"""WITH {SCORED}, a AS (SELECT doc_id, (doc_id // 4) AS base, ['A', 'B', 'C', 'B'][doc_id % 4 + 1] AS variant, coalesce(pass, false) AS pass, score FROM s),
l AS (SELECT base, variant, arg_max(pass, doc_id) AS pass FROM a GROUP BY ALL), w AS (SELECT base, count(*) AS k, bool_and(pass) FILTER (variant IN ('A', 'B')) AS ok FROM l GROUP BY base)
SELECT (SELECT round(coalesce(avg(score), 0.0), 6) FROM a WHERE variant = 'C') AS mean_score, (SELECT count(*) FROM a WHERE variant = 'C') AS n, count(*) AS triplets, round(coalesce(avg(ok::int), 0.0), 6) AS pass_rate FROM w WHERE k = 3""")
def agg06_memory(spark, d):
    """agg06 over all rows, with the scores of variant C."""
    variant = F.element_at(F.array(*map(F.lit, "ABCB")), (F.col("doc_id") % 4 + 1).cast("int"))
    s = scored(spark, d).withColumn("prompt_id", F.concat(F.lit("mem-"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("-"), variant))
    return evaluation.memory_handling(s).withColumns({"mean_score": F.round("mean_score", 6), "pass_rate": F.round("pass_rate", 6)})


@query("agg07_stability", "SELECT (SELECT count(*) FROM documents) AS conversations, count(*) AS turns, round(avg(((n_chars + i) % 5 + 1 > 2)::int), 6) AS mean_score FROM (SELECT n_chars, unnest(generate_series(0, doc_id % 4)) AS i FROM documents)")
def agg07(spark, d):
    return evaluation.stability(scored(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("agg09_social_mean", "SELECT doc_id, round(((n_chars % 5 + 1) + ((n_chars + 1) % 5 + 1) + ((n_chars + 2) % 5 + 1) + ((n_chars + 3) % 5 + 1)) / 4.0::DOUBLE, 6) AS score FROM documents WHERE doc_id % 4 = 3")
def agg09(spark, d):
    s = scored(spark, d).where(F.size("sub_scores") == 4)
    return s.select("doc_id", F.round(F.aggregate(F.map_values("sub_scores"), F.lit(0.0), lambda a, x: a + x) / 4, 6).alias("score"))


@query("agg10_stable_fraction", "SELECT doc_id, round(avg(((n_chars + i) % 5 + 1 > 2)::int), 6) AS score FROM (SELECT doc_id, n_chars, unnest(generate_series(0, doc_id % 4)) AS i FROM documents) GROUP BY doc_id")
def agg10(spark, d):
    v = F.map_values("sub_scores")
    return scored(spark, d).select("doc_id", F.round(F.size(F.filter(v, lambda x: x > 2)) / F.size(v), 6).alias("score"))


@query("flt26_flagged", f"WITH {SCORED} SELECT DISTINCT prompt_id FROM s WHERE score <= 2")
def flt26(spark, d):
    """Also SET09; unknown suites are flagged too."""
    return evaluation.flagged(scored(spark, d))


@query("flt08_tool_check", """WITH a AS (SELECT doc_id, ['wiki', 'delegate', 'none', 'any'][doc_id % 4 + 1] AS expected, CASE n_chars % 3 WHEN 0 THEN [] WHEN 1 THEN ['search_knowledge', 'recall'] ELSE ['delegate'] END AS calls FROM documents)
SELECT doc_id, CASE expected WHEN 'wiki' THEN list_has_any(calls, ['search_knowledge', 'read_knowledge']) WHEN 'delegate' THEN list_contains(calls, 'delegate') WHEN 'none' THEN len(calls) = 0 END AS ok FROM a""")
def flt08(spark, d):
    """Also ARR01."""
    expected = F.element_at(F.array(*map(F.lit, ["wiki", "delegate", "none", "any"])), (F.col("doc_id") % 4 + 1).cast("int"))
    calls = F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<string>")).when(F.col("n_chars") % 3 == 1, F.array(F.lit("search_knowledge"), F.lit("recall"))).otherwise(F.array(F.lit("delegate")))
    return table(spark, d, "documents").select("doc_id", evaluation.tool_check(calls, expected).alias("ok"))


@query("flt03_overall_pass", """SELECT doc_id, coalesce(CASE WHEN doc_id % 9 <> 0 THEN (n_chars % 5 + 1)::DOUBLE END, 0) >= 3 AND coalesce(quality * 4.0, 0) >= 3 AND coalesce(toxic = 0, false)
AND CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'na' END <> 'fail' AND n_chars BETWEEN 100 AND 5000 AS overall_pass FROM documents LEFT JOIN labels USING (doc_id)""")
def flt03(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tool = F.when(F.col("doc_id") % 4 == 0, "pass").when(F.col("doc_id") % 4 == 1, "fail").when(F.col("doc_id") % 4 == 2, "odd")
    return j.select("doc_id", chat.overall_pass(F.when(F.col("doc_id") % 9 != 0, (F.col("n_chars") % 5 + 1).cast("double")), F.col("quality") * 4.0, F.col("toxic") == 0, tool, F.col("n_chars").between(100, 5000)).alias("overall_pass"))


@query("agg29_score_buckets", f"WITH {SCORED} SELECT count(*) AS total, round(avg(score), 6) AS mean, min(score) AS lo, max(score) AS hi, count(*) FILTER (score >= 4) AS high, count(*) FILTER (score >= 2.5 AND score < 4) AS medium, count(*) FILTER (score < 2.5) AS low FROM s")
def agg29(spark, d):
    s = F.col("score")
    return scored(spark, d).agg(F.count("*").alias("total"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.count_if(s >= 4).alias("high"), F.count_if((s >= 2.5) & (s < 4)).alias("medium"), F.count_if(s < 2.5).alias("low"))


WHOLE_LISTS = """SELECT doc_id, list_transform(range(1, len(x) + 1), lambda i: {'c': 'c' || (i % 2), 't': x[i]}) AS p,
list_transform(range(1, len(x) + 1 - CASE WHEN doc_id % 5 = 1 AND len(x) > 1 THEN 1 ELSE 0 END), lambda i: {'c': CASE WHEN doc_id % 3 = 1 AND i % 4 = 1 THEN 'other' ELSE 'c' || (i % 2) END, 't': CASE WHEN doc_id % 7 > 4 AND i % 3 = 1 THEN 'x' ELSE x[i] END}) AS g FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"""


@query("agg30_extraction_score", f"""SELECT doc_id, CASE WHEN p = g THEN 1.0::DOUBLE ELSE round(((len(p) = len(g))::int + (list_sort(list_distinct(list_transform(p, lambda z: z.c))) = list_sort(list_distinct(list_transform(g, lambda z: z.c))))::int
+ len(list_filter(range(1, least(len(p), len(g)) + 1), lambda i: p[i].t = g[i].t))::DOUBLE / len(g) + len(list_filter(range(1, least(len(p), len(g)) + 1), lambda i: p[i].c = g[i].c))::DOUBLE / len(g)) / 4, 6) END AS score FROM ({WHOLE_LISTS})""")
def agg30_parts(spark, d):
    """agg30 by the reference's four parts, over all lines of a text; every few lines of the gold ones differ."""
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    p = F.transform(lines, lambda x, k: F.struct(F.concat(F.lit("c"), ((k + 1) % 2).cast("string")).alias("character"), x.alias("text")))
    changed = F.transform("p", lambda x, k: F.struct(F.when((i % 3 == 1) & (k % 4 == 0), "other").otherwise(x.character).alias("character"), F.when((i % 7 > 4) & (k % 3 == 0), "x").otherwise(x.text).alias("text")))
    g = F.slice(changed, F.lit(1), F.size("p") - F.when((i % 5 == 1) & (F.size("p") > 1), 1).otherwise(0))
    rows = table(spark, d, "documents").select("doc_id", p.alias("p")).withColumn("g", g)
    return rows.select("doc_id", F.round(evaluation.extraction_parts(F.col("p"), F.col("g")), 6).alias("score"))


@query("agg31_weighted_score", "SELECT doc_id, round((2.0 * quality + toxic) / 3.0, 6)::DOUBLE AS score FROM labels")
def agg31(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round((2.0 * F.col("quality") + F.col("toxic")) / 3.0, 6).alias("score"))


@query("prj48_diff_labels", """WITH p AS (SELECT conv_id, turn, role, md5(text) AS t FROM conversations WHERE turn % 5 <> 4), g AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'user' END AS role, CASE WHEN turn = 1 THEN 'other' ELSE md5(text) END AS t FROM conversations WHERE turn <> 2)
SELECT coalesce(p.conv_id, g.conv_id) AS conv_id, coalesce(p.turn, g.turn) AS turn, CASE WHEN p.t IS NULL THEN 'Missing' WHEN g.t IS NULL THEN 'Extra' WHEN p.role = g.role AND p.t = g.t THEN 'Perfect' WHEN p.t = g.t THEN 'Text OK, wrong character' WHEN p.role = g.role THEN 'Character OK, wrong text' ELSE 'Complete mismatch' END AS label FROM p FULL JOIN g ON p.conv_id = g.conv_id AND p.turn = g.turn""")
def prj48(spark, d):
    c = table(spark, d, "conversations")
    p = c.where("turn % 5 <> 4").select("conv_id", "turn", F.col("role").alias("pr"), F.md5("text").alias("pt"))
    g = c.where("turn <> 2").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.col("role")).otherwise("user").alias("gr"), F.when(F.col("turn") == 1, "other").otherwise(F.md5("text")).alias("gt"))
    return p.join(g, ["conv_id", "turn"], "full").select("conv_id", "turn", evaluation.diff_label(F.col("pr"), F.col("pt"), F.col("gr"), F.col("gt")).alias("label"))


@query("agg34_repeat_probability", "SELECT l_suppkey, round(avg((l_returnflag = 'R')::int), 6) AS p FROM lineitem GROUP BY l_suppkey")
def agg34(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("p"))


@query("agg28_cache_hit_ratio", "SELECT round(CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS DOUBLE) / sum(l_quantity), 6) AS ratio FROM lineitem")
def agg28(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.round(F.sum(F.when(F.col("l_linestatus") == "O", q)) / F.sum(q), 6).alias("ratio"))


@query("agg27_usage_counters", "SELECT 'chars' AS key, CAST(sum(n_chars) AS BIGINT) AS total FROM documents UNION ALL SELECT 'rows', count(*) FROM documents")
def agg27(spark, d):
    """Also MAP03: counters add up by key."""
    usage = F.create_map(F.lit("chars"), F.col("n_chars"), F.lit("rows"), F.lit(1).cast("long"))
    return table(spark, d, "documents").select(F.explode(usage).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"))


@query("agg13_coverage", """WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n = 1) AS one, count(*) FILTER (n > 1) AS many, max(n) AS most, round(avg(n), 6) AS expansion FROM c""")
def agg13(spark, d):
    c = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))
    n = F.col("n")
    return c.agg(F.count("*").alias("total"), F.count_if(n == 0).alias("missing"), F.count_if(n == 1).alias("one"), F.count_if(n > 1).alias("many"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("expansion"))


# Claims are orders, evidence is their line items: returned items contradict.
FACTS = "f AS (SELECT l_orderkey AS claim_id, l_suppkey AS scene_id, CASE WHEN l_returnflag = 'R' THEN 'contradict' ELSE 'support' END AS kind, min(l_partkey) AS seq FROM lineitem GROUP BY ALL), u AS (SELECT claim_id, CAST(sum(CASE WHEN kind = 'support' THEN 1 ELSE -1 END) AS BIGINT) AS support, count(*) FILTER (kind = 'contradict') AS contradicting FROM f GROUP BY claim_id)"
PATH = "['identity', 'psychology', 'capabilities', 'interests', 'relationships', 'history'][o_orderkey % 6 + 1] || '/' || o_orderpriority || '/' || o_orderstatus || '/' || (o_orderkey % 50)"
CLAIMS = FACTS + f", c AS (SELECT o_orderkey AS claim_id, 'claim ' || o_orderkey AS text, {PATH} AS path, support, contradicting, CASE WHEN o_orderkey % 6 = 4 THEN 'relationship' WHEN o_orderkey % 6 = 5 THEN 'episode' ELSE 'general' END AS scope FROM orders JOIN u ON claim_id = o_orderkey)"


def facts(spark, d):
    li = table(spark, d, "lineitem")
    return ledger.apply_events(li.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("scene_id"), F.when(F.col("l_returnflag") == "R", "contradict").otherwise("support").alias("kind"), F.col("l_partkey").alias("seq")))


def claims(spark, d):
    o = table(spark, d, "orders")
    path = F.concat_ws("/", F.element_at(F.array(*map(F.lit, ledger.SECTIONS)), (F.col("o_orderkey") % 6 + 1).cast("int")), "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string"))
    c = o.select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("claim "), F.col("o_orderkey").cast("string")).alias("text"), path.alias("path"))
    return c.withColumn("scope", ledger.scope(F.col("path"))).join(ledger.support(facts(spark, d)), "claim_id")


@query("stm07_evidence_facts", f"WITH {FACTS} SELECT claim_id, scene_id, kind, seq FROM f")
def stm07(spark, d):
    return facts(spark, d)


@query("agg14_support", f"WITH {FACTS} SELECT * FROM u")
def agg14(spark, d):
    return ledger.support(facts(spark, d))


@query("agg15_support_histogram", f"WITH {CLAIMS} SELECT split_part(path, '/', 1) AS section, support, count(*) AS n FROM c GROUP BY ALL")
def agg15(spark, d):
    """Also PRJ25: the fact table is the flattened ledger."""
    return claims(spark, d).groupBy(F.split("path", "/")[0].alias("section"), "support").agg(F.count("*").alias("n"))


@query("prj27_scope", f"WITH {CLAIMS} SELECT claim_id, scope FROM c")
def prj27(spark, d):
    return claims(spark, d).select("claim_id", "scope")


@query("prj28_path_prefix", f"WITH {CLAIMS} SELECT array_to_string(string_split(path, '/')[1:2], '/') AS prefix, count(*) AS n FROM c GROUP BY 1")
def prj28(spark, d):
    return claims(spark, d).groupBy(ledger.path_prefix(F.col("path"), 2).alias("prefix")).agg(F.count("*").alias("n"))


@query("flt06_valid_path", "WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'identity/' || source WHEN 1 THEN 'identity' WHEN 2 THEN 'nope/a' WHEN 3 THEN 'history//x' ELSE 'history/a/b/c/d' END AS p FROM documents) SELECT doc_id, len(string_split(p, '/')) BETWEEN 2 AND 4 AND string_split(p, '/')[1] IN ('identity', 'history') AND NOT list_contains(string_split(p, '/'), '') AS ok FROM a")
def flt06(spark, d):
    i = F.col("doc_id") % 5
    p = F.when(i == 0, F.concat(F.lit("identity/"), F.col("source"))).when(i == 1, "identity").when(i == 2, "nope/a").when(i == 3, "history//x").otherwise("history/a/b/c/d")
    return table(spark, d, "documents").select("doc_id", ledger.valid_path(p).alias("ok"))


@query("flt17_support_filters", f"WITH {CLAIMS} SELECT claim_id, support > 0 AND support < 3 AS low, support >= 3 AS eligible, contradicting > 0 AS contradicted FROM c")
def flt17(spark, d):
    s = F.col("support")
    return claims(spark, d).select("claim_id", ((s > 0) & (s < 3)).alias("low"), (s >= 3).alias("eligible"), (F.col("contradicting") > 0).alias("contradicted"))


@query("flt18_generalizable", f"WITH {CLAIMS} SELECT claim_id FROM c WHERE (path LIKE 'identity/%' OR path LIKE 'psychology/%') AND path NOT LIKE 'identity/1-URGENT%'")
def flt18(spark, d):
    p = F.col("path")
    return claims(spark, d).where((p.startswith("identity/") | p.startswith("psychology/")) & ~p.startswith("identity/1-URGENT")).select("claim_id")


@query("flt28_claims_by_prefix", f"WITH {CLAIMS} SELECT claim_id FROM c WHERE starts_with(path, 'history/2')")
def flt28(spark, d):
    """Also FLT30."""
    return claims(spark, d).where(F.col("path").startswith("history/2")).select("claim_id")


@query("agg26_merge_evidence", "WITH f AS (SELECT o_custkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT o_custkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY o, l_suppkey) AS merged FROM f GROUP BY 1")
def agg26(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ledger.merge_ordered(j, "o_custkey", "l_suppkey", "o", "m").select("o_custkey", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("merged"))


@query("top04_claims_by_section", f"WITH {CLAIMS} SELECT claim_id, split_part(path, '/', 1) AS section, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY support DESC, claim_id) AS rank FROM c")
def top04(spark, d):
    return ledger.by_section(claims(spark, d)).select("claim_id", "section", "rank")


@query("top05_top_claims", f"WITH {CLAIMS} SELECT claim_id, support FROM c ORDER BY support DESC, claim_id LIMIT 50")
def top05(spark, d):
    return claims(spark, d).orderBy(F.desc("support"), "claim_id").limit(50).select("claim_id", "support")


@query("str11_claim_lines", f"WITH {CLAIMS} SELECT path, string_agg('[' || CASE WHEN support > 0 THEN '+' ELSE '' END || support || '] ' || text, chr(10) ORDER BY claim_id) AS lines FROM c GROUP BY path")
def str11(spark, d):
    """Also PRJ42: claims rendered by path."""
    lines = claims(spark, d).withColumn("line", F.concat(T.signed("support"), F.lit(" "), "text"))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "line"))), lambda x: x.line), "\n").alias("lines"))


@query("itr02_refine", f"WITH {CLAIMS} SELECT claim_id, support + 2 * contradicting AS support FROM c")
def itr02(spark, d):
    return ledger.support(ledger.refine(facts(spark, d))).join(claims(spark, d).select("claim_id"), "claim_id").select("claim_id", "support")


def _pass(n, source):
    p = f"array_to_string(string_split(path, '/')[1:{n}], '/')"
    return f"SELECT arg_max(claim_id, (support, -claim_id)) AS claim_id, arg_max(text, (support, -claim_id)) AS text, CASE WHEN count(*) > 1 THEN {p} ELSE any_value(path) END AS path, CASE WHEN count(*) > 1 THEN 'general' ELSE any_value(scope) END AS scope, CAST(sum(support) AS BIGINT) AS support FROM {source} GROUP BY {p}"


@query("itr01_condense", f"WITH {CLAIMS}, p3 AS ({_pass(3, 'c')}), p2 AS ({_pass(2, 'p3')}) SELECT * FROM p2")
def itr01(spark, d):
    """Also SET11: unchanged claims stay in the working set."""
    return ledger.condense(claims(spark, d).drop("contradicting"), (3, 2))


@query("itr03_generalized", f"WITH {CLAIMS} SELECT split_part(path, '/', 1) AS section, 'generalized' AS scene_id, count(*) AS n FROM c WHERE support >= 3 GROUP BY 1 UNION ALL SELECT split_part(path, '/', 1), 'own', count(*) FROM c GROUP BY 1")
def itr03(spark, d):
    own = claims(spark, d).withColumn("section", F.split("path", "/")[0])
    rows = own.select("section", F.lit("own").alias("scene_id")).unionByName(own.where("support >= 3").select("section", F.lit("generalized").alias("scene_id")))
    return rows.groupBy("section", "scene_id").agg(F.count("*").alias("n"))


@query("itr04_document", f"""WITH {CLAIMS} SELECT split_part(path, '/', 1) AS section, string_agg('- ' || CASE WHEN scope <> 'general' THEN '(' || scope || ') ' ELSE '' END || text, chr(10) ORDER BY support DESC, claim_id) AS body,
CAST(list_position(['identity', 'psychology', 'capabilities', 'interests', 'relationships', 'history'], split_part(path, '/', 1)) AS BIGINT) AS ord FROM c WHERE support >= 4 GROUP BY 1""")
def itr04(spark, d):
    return ledger.document(claims(spark, d), 4)


@query("flt20_range_issues", "SELECT doc_id, array_to_string(list_filter([CASE WHEN quality NOT BETWEEN 0 AND 0 THEN 'quality' END, CASE WHEN toxic NOT BETWEEN 0 AND 0 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS issues FROM labels")
def flt20(spark, d):
    checks = F.array(*[F.when(~F.col(c).between(0, 0), F.lit(c)) for c in ("quality", "toxic")])
    return table(spark, d, "labels").select("doc_id", F.array_join(F.filter(checks, lambda x: x.isNotNull()), ",").alias("issues"))


@query("prj46_default_sections", "SELECT doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'none') AS toxic FROM documents LEFT JOIN labels l USING (doc_id)")
def prj46(spark, d):
    """Also MAP01."""
    section = F.when(F.col("quality").isNotNull(), F.struct(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")))
    default = F.struct(F.lit("none").alias("quality"), F.lit("none").alias("toxic"))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(section, default).alias("s")).select("doc_id", "s.*")


@query("snk09_report_json", f"WITH {SCORED} SELECT '{{\"n\":' || count(*) || ',\"flagged\":' || count(*) FILTER (score <= 2) || '}}' AS report FROM s")
def snk09(spark, d):
    one = scored(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("score") <= 2).alias("flagged"))
    return one.select(F.to_json(F.struct("n", "flagged")).alias("report"))
