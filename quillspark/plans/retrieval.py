"""Queries over documents and pages: search, dedup, sampling, text functions, composition."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import compose, sampling, search
from .base import query, table

TOKS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"
U = "(('0x' || substr(md5('{}|' || CAST({} AS VARCHAR)), 1, 13))::UBIGINT / 4503599627370496::DOUBLE)"
SEARCH = [(0, "the of"), (1, "le la les la"), (2, "zzzz qqqq"), (3, "der und zzzz")]


def documents(spark, d):
    return table(spark, d, "documents")


@query("agg35_corpus_stats", f"""WITH p AS (SELECT doc_id, unnest({TOKS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, round(ln(any_value(n.n) + 1.0) - ln(count(DISTINCT doc_id) + 0.5), 6) AS idf FROM p, n GROUP BY term""")
def agg35(spark, d):
    docs = documents(spark, d)
    df = search.document_frequency(docs, F.col("text"))
    return df.join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.round(F.log(F.col("n") + 1.0) - F.log(F.col("df") + 0.5), 6).alias("idf"))


BM25 = f"""WITH q AS (SELECT * FROM (VALUES (0, 'the'), (0, 'of'), (1, 'le'), (1, 'la'), (1, 'les'), (1, 'la'), (2, 'zzzz'), (2, 'qqqq'), (3, 'der'), (3, 'und'), (3, 'zzzz')) t(query_id, term)),
t AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
d AS (SELECT doc_id, {TOKS} AS toks FROM documents), s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT query_id, t.term, qtf, ln(s.n + 1.0) - ln(f.df + 0.5) AS idf, s.avgdl FROM t JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) f USING (term), s),
sc AS (SELECT w.query_id, d.doc_id, sum(w.idf * w.qtf * 2.5 * (coalesce(p.tf / (0.25 + 0.75 * p.dl / w.avgdl), 0) + 0.5) / (1.5 + coalesce(p.tf / (0.25 + 0.75 * p.dl / w.avgdl), 0) + 0.5)) AS score
FROM w CROSS JOIN d LEFT JOIN p ON p.doc_id = d.doc_id AND p.term = w.term GROUP BY ALL)
"""


def scored(spark, d):
    queries = spark.createDataFrame(SEARCH, "query_id int, query string")
    return search.bm25l(documents(spark, d), "doc_id", F.col("text"), queries)


@query("jon17_bm25l_scores", BM25 + "SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 4) AS score FROM sc")
def jon17(spark, d):
    return scored(spark, d).select(F.col("query_id").cast("long").alias("query_id"), "doc_id", F.round("score", 4).alias("score"))


@query("top01_bm25l_top5", BM25 + ", r AS (SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id DESC) AS rank FROM sc) SELECT CAST(query_id AS BIGINT) AS query_id, rank, doc_id, score FROM r WHERE rank <= 5 AND score > 0")
def top01(spark, d):
    """Also TOP02 and UDF05: the search over any text column; ties go to the later document, the cut comes before score > 0."""
    queries = spark.createDataFrame(SEARCH, "query_id int, query string")
    best = search.bm25l_best(documents(spark, d), "doc_id", F.col("text"), queries, 5)
    return best.where("score > 0").select(F.col("query_id").cast("long").alias("query_id"), "rank", "doc_id", F.round("score", 4).alias("score"))


def _count(col, w):
    return f"CAST((length({col}) - length(replace({col}, '{w}', ''))) / {len(w)} AS BIGINT)"


@query("top03_keyword_search", f"""WITH s AS (SELECT doc_id, {_count('lower(text)', 'tion')} + 5 * {_count('lower(source)', 'tion')} + {_count('lower(text)', 'der')} + 5 * {_count('lower(source)', 'der')} + {_count('lower(text)', 'src1')} + 5 * {_count('lower(source)', 'src1')} AS score FROM documents)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def top03(spark, d):
    low = documents(spark, d).select("doc_id", F.lower("text").alias("content"), F.lower("source").alias("heading"))
    s = low.select("doc_id", search.keyword_score(F.col("content"), F.col("heading"), ["tion", "der", "src1"]).alias("score")).where("score > 0")
    return search.best(s, 20, F.desc("score"), "doc_id")


@query("str06_occurrences", f"SELECT doc_id, {_count('text', 'en')} AS n FROM documents")
def str06(spark, d):
    return documents(spark, d).select("doc_id", T.occurrences("text", "en").alias("n"))


@query("set05_distinct_content", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text")
def set05(spark, d):
    """Also HSH02."""
    return search.distinct_content(documents(spark, d), "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("h"))


@query("flt16_too_long", "SELECT doc_id FROM documents WHERE length(text) <= 32767.5")
def flt16(spark, d):
    return documents(spark, d).where(F.length("text") <= 65535 / 2).select("doc_id")


@query("flt19_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'reor') ORDER BY doc_id LIMIT 20")
def flt19(spark, d):
    return documents(spark, d).where(F.contains(F.lower("text"), F.lower(F.lit("REOR")))).select("doc_id").orderBy("doc_id").limit(20)


@query("flt27_eval_overlap", """SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(trim(b.text)) = lower(trim(d.text)))""")
def flt27(spark, d):
    norm = F.lower(F.trim("text"))
    return documents(spark, d).withColumn("k", norm).join(table(spark, d, "benchmark").select(norm.alias("k")), "k", "left_anti").select("doc_id")


@query("agg33_index_totals", f"SELECT max(len({TOKS})) AS longest, round(avg(len({TOKS})), 6) AS mean, CAST(sum(len({TOKS}) * 13 // 10) AS BIGINT) AS tokens FROM documents")
def agg33(spark, d):
    n = documents(spark, d).select(F.size(T.tokens("text")).cast("long").alias("n"), T.token_estimate("text").alias("t"))
    return n.agg(F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.sum("t").alias("tokens"))


@query("agg12_count_by_category", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def agg12(spark, d):
    return documents(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source")


@query("agg16_frequency_top10", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def agg16(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("agg17_common_combination", """WITH c AS (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source) SELECT langs, count(*) AS n FROM c GROUP BY langs""")
def agg17(spark, d):
    """Also SET08 and ARR04: sets are compared as sorted distinct arrays."""
    c = documents(spark, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return c.groupBy("langs").agg(F.count("*").alias("n"))


@query("agg18_distinct_per_group", "SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def agg18(spark, d):
    return documents(spark, d).groupBy("source").agg(F.size(F.collect_set("lang")).cast("long").alias("langs"))


def missing_positions(rows, key, position, width=1 << 12):
    """Positions between a key's least and greatest that it has no row for.

    Gaps are found by lead() within blocks of ``width`` positions, so no task
    orders all positions of a key, and between the edges of the blocks.
    """
    have = rows.where(F.col(position).isNotNull()).select(key, F.col(position).cast("long").alias("p")).distinct().withColumn("b", F.floor(F.col("p") / width))
    inner = have.withColumn("next", F.lead("p").over(W.partitionBy(key, "b").orderBy("p"))).select(key, "p", "next")
    edges = have.groupBy(key, "b").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    outer = edges.withColumn("next", F.lead("lo").over(W.partitionBy(key).orderBy("b"))).select(key, F.col("hi").alias("p"), "next")
    return inner.unionByName(outer).where("next > p + 1").select(key, F.explode(F.sequence(F.col("p") + 1, F.col("next") - 1)).alias("missing"))


@query("flt13_exact_character_set", "SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) = 2 AND bool_or(lang = 'en')")
def flt13(spark, d):
    """Also FLT14: equality with a set of known size."""
    sets = documents(spark, d).groupBy("source").agg(F.collect_set("lang").alias("s"))
    return sets.where((F.size("s") == 2) & F.array_contains("s", "en")).select("source")


@query("set06_set_algebra", """WITH s AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY source)
SELECT source, array_to_string(list_filter(['de', 'en', 'it'], lambda x: list_contains(l, x)), ',') AS both, array_to_string(list_filter(['de', 'en', 'it'], lambda x: NOT list_contains(l, x)), ',') AS missing FROM s""")
def set06(spark, d):
    """Also SET07, FLT21 and FLT22: required minus present."""
    need = F.array(F.lit("de"), F.lit("en"), F.lit("it"))
    s = documents(spark, d).groupBy("source").agg(F.collect_set("lang").alias("l"))
    return s.select("source", F.array_join(F.array_sort(F.array_intersect(need, "l")), ",").alias("both"), F.array_join(F.array_sort(F.array_except(need, "l")), ",").alias("missing"))


@query("flt25_missing_positions", "SELECT source, r AS missing FROM (SELECT source, unnest(generate_series(min(doc_id), max(doc_id))) AS r FROM documents GROUP BY source) WHERE (source, r) NOT IN (SELECT source, doc_id FROM documents)")
def flt25(spark, d):
    return missing_positions(documents(spark, d), "source", "doc_id")


@query("top10_sample", f"SELECT doc_id FROM documents ORDER BY {U.format('s1', 'doc_id')}, doc_id LIMIT 50")
def top10(spark, d):
    """Also TOP13: the order of the sample is the shuffle."""
    return sampling.sample(documents(spark, d).select("doc_id"), 50, "s1", "doc_id")


@query("top11_weighted_sample", f"SELECT doc_id FROM documents ORDER BY pow({U.format('s2', 'doc_id')}, 1.0 / n_chars) DESC, doc_id LIMIT 50")
def top11(spark, d):
    return sampling.weighted_sample(documents(spark, d), 50, "s2", "doc_id", F.col("n_chars")).select("doc_id")


@query("top12_choose_one", f"""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars >= 2500 THEN 0 ELSE 1 END, {U.format('s3', 'doc_id')}, doc_id) AS r FROM documents) SELECT source, doc_id FROM r WHERE r = 1""")
def top12(spark, d):
    return sampling.choose_one(documents(spark, d).select("source", "doc_id", "n_chars"), "source", "doc_id", "s3", F.col("n_chars") >= 2500).select("source", "doc_id")


@query("top14_split", f"SELECT doc_id, {U.format('s4', 'doc_id')} < 0.9 AS train FROM documents")
def top14(spark, d):
    return documents(spark, d).select("doc_id", sampling.split("doc_id", "s4", 0.9).alias("train"))


@query("win17_round_robin", f"""WITH e AS (SELECT n_name, epoch, {U.format('s5', "(epoch || '|' || n_name)")} AS u FROM nation, (SELECT unnest(generate_series(0, 2)) AS epoch))
SELECT * FROM (SELECT epoch * 25 + row_number() OVER (PARTITION BY epoch ORDER BY u, n_name) - 1 AS i, n_name FROM e) WHERE i < 60""")
def win17(spark, d):
    return sampling.round_robin(table(spark, d, "nation").select("n_name"), "n_name", 60, "s5")


@query("top18_random_parameters", f"SELECT doc_id, CAST(3 + floor({U.format('s6', 'doc_id')} * 4) AS BIGINT) AS turn_count FROM documents")
def top18(spark, d):
    return documents(spark, d).select("doc_id", (F.lit(3) + F.floor(T.uniform("s6", "doc_id") * 4)).cast("long").alias("turn_count"))


@query("jon15_cross_product", """SELECT r_name, c AS mood, n AS turns FROM region, (SELECT unnest(['calm', 'sad', 'angry']) AS c), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE NOT (r_name = 'ASIA' AND c = 'sad')""")
def jon15(spark, d):
    """Also FLT05, JON16, SRC28 and SET02."""
    moods = spark.createDataFrame([("calm",), ("sad",), ("angry",)], "mood string")
    turns = spark.createDataFrame([(1,), (2,), (3,), (4,)], "turns int")
    all_rows = compose.product(table(spark, d, "region").select("r_name"), moods, turns)
    return compose.excluding(all_rows, spark.createDataFrame([("ASIA", "sad")], "r_name string, mood string"), ["r_name", "mood"])


ENTRIES = "SELECT doc_id AS entry_id, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' END AS character, doc_id % 60 AS days_ago, list_distinct([lang, source]) AS tags FROM documents"
PROFILES = "SELECT n_nationkey AS profile_id, CASE WHEN n_nationkey % 2 = 0 THEN 'a' END AS character, ['src' || n_nationkey % 20, CASE WHEN n_nationkey % 5 = 0 THEN 'fr' ELSE 'xx' END] AS tags FROM nation"


def entries(spark, d):
    c = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")
    return documents(spark, d).select(F.col("doc_id").alias("entry_id"), c.alias("character"), (F.col("doc_id") % 60).alias("days_ago"), F.array("lang", "source").alias("tags"))


def profiles(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("long").alias("profile_id"), F.when(k % 2 == 0, "a").alias("character"), F.array(F.concat(F.lit("src"), (k % 20).cast("string")), F.when(k % 5 == 0, "fr").otherwise("xx")).alias("tags"))


@query("jon14_tag_overlap", f"SELECT CAST(profile_id AS BIGINT) AS profile_id, entry_id FROM ({PROFILES}) p JOIN ({ENTRIES}) e ON list_has_any(p.tags, e.tags) AND (p.character IS NULL OR p.character = e.character)")
def jon14(spark, d):
    """Also FLT04 and SET04: what is not listed is the complement."""
    return compose.relevant(profiles(spark, d), entries(spark, d)).select("profile_id", "entry_id")


@query("top06_recent_memories", f"""WITH r AS (SELECT profile_id, entry_id, row_number() OVER (PARTITION BY profile_id ORDER BY days_ago, entry_id) AS rank FROM ({PROFILES}) p JOIN ({ENTRIES}) e ON list_has_any(p.tags, e.tags) AND (p.character IS NULL OR p.character = e.character))
SELECT CAST(profile_id AS BIGINT) AS profile_id, entry_id, rank FROM r WHERE rank <= 5""")
def top06(spark, d):
    return search.best(compose.relevant(profiles(spark, d), entries(spark, d)), 5, "days_ago", "entry_id", group=["profile_id"]).select("profile_id", "entry_id", "rank")


@query("prj26_relative_time", """SELECT doc_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 30 THEN (d // 7) || CASE WHEN d // 7 = 1 THEN ' week ago' ELSE ' weeks ago' END ELSE (d // 30) || CASE WHEN d // 30 = 1 THEN ' month ago' ELSE ' months ago' END END AS age FROM (SELECT doc_id, doc_id % 100 AS d FROM documents)""")
def prj26(spark, d):
    """Also DAT02 and MTH03."""
    return documents(spark, d).select("doc_id", T.relative_time(F.col("doc_id") % 100).alias("age"))


@query("prj20_slug", "SELECT page_id, trim(replace(regexp_replace(lower(url), '[^a-z0-9]', '-', 'g'), '--', '-'), '-') AS slug FROM pages")
def prj20(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug("url").alias("slug"))


@query("prj21_url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/(\\w+)/(\\d+)', 1) AS host, 'https://' || regexp_extract(url, '^https?://([^/]+)/(\\w+)/(\\d+)', 1) || '/api?id=' || regexp_extract(url, '^https?://([^/]+)/(\\w+)/(\\d+)', 3) AS api FROM pages")
def prj21(spark, d):
    """Also STR08."""
    part = lambda i: F.regexp_extract("url", r"^https?://([^/]+)/(\w+)/(\d+)", i)
    return table(spark, d, "pages").select("page_id", part(1).alias("host"), F.concat(F.lit("https://"), part(1), F.lit("/api?id="), part(3)).alias("api"))


@query("prj22_markup_strip", """SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<h1>([^<]*)</h1>', '\n# \\1\n', 'g'), '<li>', '\n- ', 'g'), '<[^>]*>', '', 'g')) AS h FROM pages""")
def prj22(spark, d):
    t = F.regexp_replace("html", r"<h1>([^<]*)</h1>", "\n# $1\n")
    return table(spark, d, "pages").select("page_id", F.md5(F.regexp_replace(F.regexp_replace(t, "<li>", "\n- "), "<[^>]*>", "")).alias("h"))


@query("prj17_canonical_names", """SELECT doc_id, CASE WHEN regexp_full_match(lower(trim(source)), 'src(0|1|2)') THEN 'Uno' WHEN regexp_full_match(lower(trim(source)), 'src1\\d?') THEN 'Due' ELSE trim(source) END AS name FROM documents""")
def prj17(spark, d):
    """Also PRJ18: the first cluster whose pattern matches the whole name gives the name."""
    s = F.lower(F.trim("source"))
    return documents(spark, d).select("doc_id", F.when(s.rlike("^(src(0|1|2))$"), "Uno").when(s.rlike(r"^(src1\d?)$"), "Due").otherwise(F.trim("source")).alias("name"))


@query("prj19_path_tail", "SELECT page_id, array_to_string(string_split(url, '/')[4:5], '/') AS tail FROM pages")
def prj19(spark, d):
    """Also ARR02."""
    return table(spark, d, "pages").select("page_id", F.array_join(F.slice(F.split("url", "/"), 4, 2), "/").alias("tail"))


@query("prj14_judge_response", """SELECT doc_id, CAST(quality AS BIGINT) AS quality, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 1 END AS toxic, doc_id % 7 = 0 AS broken FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, NULL, NULL, true FROM labels WHERE doc_id % 7 = 0""")
def prj14(spark, d):
    """Also PRJ15, PRJ16, JSN01 and JSN02: fenced, list or broken JSON."""
    t = F.when(F.col("toxic") == 1, "true").otherwise("false")
    body = F.concat(F.lit('{"quality": '), F.col("quality").cast("string"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(', "toxic": '), t)).otherwise(F.lit("")), F.lit("}"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit("{nope")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n["), body, F.lit("]\n```"))).otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    clean = table(spark, d, "labels").select("doc_id", T.strip_fences(raw).alias("j"))
    shape = "quality long, toxic boolean"
    one = F.when(clean.j.startswith("["), F.try_element_at(F.from_json("j", f"array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>"), F.lit(1))).otherwise(F.from_json("j", shape))
    return clean.withColumn("r", one).select("doc_id", "r.quality", "r.toxic", F.coalesce(F.col("r.quality").isNull(), F.lit(True)).alias("broken"))


@query("str05_truncate", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS t, left(sha1(text), 8) AS version FROM documents")
def str05(spark, d):
    """Also HSH01."""
    return documents(spark, d).select("doc_id", T.truncate("text", 60).alias("t"), T.short_hash("text").alias("version"))


@query("str04_strip_quotes", "SELECT doc_id, trim(trim('\" ' || lang || '\"'), '\"') AS t FROM documents")
def str04(spark, d):
    return documents(spark, d).select("doc_id", T.strip_quotes(F.concat(F.lit('" '), "lang", F.lit('"'))).alias("t"))


@query("str12_unique_replace", "SELECT doc_id, CASE WHEN (length(text) - length(replace(text, 'Elle', ''))) / 4 = 1 THEN md5(replace(text, 'Elle', 'Lui')) END AS h FROM documents")
def str12(spark, d):
    """Also STR13 and PRJ45: an edit applies only where its target occurs once."""
    once = T.occurrences("text", "Elle") == 1
    return documents(spark, d).select("doc_id", F.when(once, F.md5(F.replace("text", F.lit("Elle"), F.lit("Lui")))).alias("h"))


@query("prj36_numbered_lines", """SELECT doc_id, i - 1 AS line_no, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE i BETWEEN 2 AND 4""")
def prj36(spark, d):
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where("n between 1 and 3").select("doc_id", F.col("n").cast("long").alias("line_no"), "line")


@query("top07_natural_order", """SELECT source, row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT)) AS rank FROM (SELECT DISTINCT source FROM documents)""")
def top07(spark, d):
    """Also TOP08: numbers in names order by value."""
    s = documents(spark, d).select("source").distinct()
    return s.withColumn("rank", F.row_number().over(W.orderBy(T.natural_key(F.regexp_replace("source", "^src", "src-")))).cast("long"))


@query("top16_largest_splits", f"SELECT doc_id, len({TOKS}) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 10")
def top16(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.tokens("text")).cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


@query("agg24_softmax", """WITH m AS (SELECT max(n_chars / 1000.0::DOUBLE) AS m FROM documents), s AS (SELECT sum(exp(n_chars / 1000.0::DOUBLE - m)) AS s FROM documents, m)
SELECT doc_id, round(exp(n_chars / 1000.0::DOUBLE - m) / s, 9) AS p FROM documents, m, s""")
def agg24(spark, d):
    """Also MTH02: the maximum and the sum are one row, joined back."""
    x = F.col("n_chars") / 1000.0
    docs = documents(spark, d).select("doc_id", x.alias("x"))
    top = docs.agg(F.max("x").alias("m"))
    total = docs.crossJoin(F.broadcast(top)).agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("s"), F.first("m").alias("m"))
    return docs.crossJoin(F.broadcast(total)).select("doc_id", F.round(F.exp(F.col("x") - F.col("m")) / F.col("s"), 9).alias("p"))
