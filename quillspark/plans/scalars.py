"""Queries of single scalar functions, and of scans, sinks, joins and sets that share an operator with another id."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import backend as B
from ..functions import text as T
from ..operators import consensus, sampling
from ..sources import archives, readers, sinks, workspace
from .base import query, table

WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"


def documents(spark, d):
    return table(spark, d, "documents")


@query("str01_tokens", f"SELECT doc_id, array_to_string({WORDS}, '|') AS tokens FROM documents")
def str01(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.tokens("text"), "|").alias("tokens"))


@query("str08_regex", r"SELECT page_id, regexp_extract(url, '/([a-z]+)/', 1) AS part, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, '[0-9]{2}') AS numbered FROM pages")
def str08(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([a-z]+)/", 1).alias("part"), F.regexp_replace("url", "[0-9]+", "#").alias("masked"), F.col("url").rlike("[0-9]{2}").alias("numbered"))


@query("str09_base_and_variant", "SELECT doc_id, 'mem-' || lang || '-' || doc_id AS base, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE '' END AS variant FROM documents")
def str09(spark, d):
    base, variant = T.base_and_variant(F.concat(F.lit("mem-"), "lang", F.lit("-"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "-A").otherwise("-")))
    return documents(spark, d).select("doc_id", base.alias("base"), variant.alias("variant"))


@query("str13_unique_line", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, lower(trim(line, ' ')) AS k FROM l)
SELECT doc_id, k AS line, count(*) AS n, count(*) = 1 AS is_unique FROM k WHERE k <> '' GROUP BY doc_id, k""")
def str13(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("doc_id", F.lower(F.btrim("line")).alias("line")).where("line <> ''").groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return found.withColumn("is_unique", F.col("n") == 1)


@query("mth02_exp_log", "SELECT doc_id, round(exp(-n_chars / 1000.0), 9) AS decay, round(ln(n_chars + 1), 9) AS size FROM documents")
def mth02(spark, d):
    return documents(spark, d).select("doc_id", F.round(F.exp(-F.col("n_chars") / 1000.0), 9).alias("decay"), F.round(F.log(F.col("n_chars") + 1), 9).alias("size"))


@query("mth03_floor_division", "SELECT event_id, CAST(floor((event_id - 500) / 7.0) AS BIGINT) AS weeks FROM events")
def mth03(spark, d):
    """Toward minus infinity, unlike ``div``."""
    return table(spark, d, "events").select("event_id", F.floor((F.col("event_id") - 500) / 7).alias("weeks"))


@query("mth04_batch_size", """WITH s AS (SELECT doc_id, n, CASE WHEN doc_id = 0 THEN 0 ELSE (doc_id - 1) % n + 1 END AS last FROM documents, (SELECT unnest([8, 9, 10]) AS n))
SELECT doc_id, CAST(arg_max(n, last * 100 + n) AS BIGINT) AS size FROM s GROUP BY doc_id""")
def mth04(spark, d):
    total = F.col("doc_id")
    last = lambda n: F.when(total == 0, 0).otherwise((total - 1) % n + 1)
    size = F.greatest(*[F.struct(last(n).alias("last"), F.lit(n).cast("long").alias("n")) for n in range(8, 11)])["n"]
    return documents(spark, d).select("doc_id", size.alias("size"))


@query("mth05_backoff", "SELECT i AS attempt, least(60.0, 2.0 * pow(2, i)) AS plain, least(60.0, 2.0 * pow(2, i)) * 1.25 AS most, least(60.0, 2.0 * pow(2, i)) * 0.75 AS least FROM (SELECT unnest(range(8)) AS i)")
def mth05(spark, d):
    rows = [(i, B.backoff(i), B.backoff(i, 1.0), B.backoff(i, -7.0)) for i in range(8)]
    return spark.createDataFrame(rows, "attempt long, plain double, most double, least double")


@query("stm10_retries", "SELECT failures, result, calls, waited::DOUBLE AS waited FROM (VALUES (0, 'done', 1, 0.0), (1, 'done', 2, 2.0), (2, 'done', 3, 6.0), (3, NULL, 3, 6.0), (9, NULL, 3, 6.0)) t(failures, result, calls, waited)")
def stm10(spark, d):
    """Three attempts on overload with growing waits; a batch that fails for good gives nothing."""

    def run(failures):
        calls, waits = [], []

        def work():
            calls.append(1)
            if len(calls) <= failures:
                raise ConnectionError("overloaded")
            return "done"

        return failures, B.with_retries(work, 3, waits.append), len(calls), float(sum(waits))

    return spark.createDataFrame([run(n) for n in (0, 1, 2, 3, 9)], "failures int, result string, calls int, waited double")


@query("arr01_contains_any_all", f"SELECT doc_id, list_contains({WORDS}, 'the') AS has, list_has_any({WORDS}, ['der', 'le']) AS some, len(list_filter({WORDS}, lambda x: length(x) > 20)) > 0 AS long_word, len(list_filter({WORDS}, lambda x: length(x) > 20)) = 0 AS all_short FROM documents")
def arr01(spark, d):
    w = F.col("w")
    return documents(spark, d).select("doc_id", T.tokens("text").alias("w")).select(
        "doc_id", F.array_contains(w, "the").alias("has"), F.arrays_overlap(w, F.array(F.lit("der"), F.lit("le"))).alias("some"),
        F.exists(w, lambda x: F.length(x) > 20).alias("long_word"), F.forall(w, lambda x: F.length(x) <= 20).alias("all_short"))


@query("arr04_sorted_distinct", "SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(left(source || lang, 40)), ''))), '') AS letters FROM documents")
def arr04(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.concat("source", "lang")), ""))), "").alias("letters"))


@query("map01_get_default", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'other' END AS name FROM documents")
def map01(spark, d):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("fr"), F.lit("French"))
    return documents(spark, d).select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("name"))


@query("map02_first_wins", "SELECT source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def map02(spark, d):
    return documents(spark, d).groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"))


@query("jsn01_round_trip", "SELECT doc_id, lang, text FROM documents")
def jsn01(spark, d):
    """Letters beyond ASCII stay as they are."""
    j = F.to_json(F.struct("lang", "text")).alias("j")
    return documents(spark, d).select("doc_id", j).select("doc_id", F.from_json("j", "lang string, text string").alias("x")).select("doc_id", "x.*")


@query("jsn02_tolerant_parse", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS value FROM documents")
def jsn02(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"v": '), i)).otherwise(F.concat(F.lit('{"v": '), i, F.lit("}")))
    return documents(spark, d).select("doc_id", F.try_parse_json(raw).alias("v")).select("doc_id", F.try_variant_get("v", "$.v", "bigint").alias("value"))


SCHEMA = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}}}, "c": {"type": "object"}}}
CLOSED = '{"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}, "additionalProperties": false}}, "c": {"type": "object", "additionalProperties": false}}, "additionalProperties": false}'


@query("jsn03_closed_schema", f"SELECT '{CLOSED}' AS closed")
def jsn03(spark, d):
    return spark.range(1).select(F.lit(json.dumps(B.closed(SCHEMA))).alias("closed"))


def pick(names: list, flag: bool = False, weight: float = 1.0) -> str:
    """Picks one."""
    return names[0]


@query("udf04_schema_text", """SELECT '{"name": "pick", "description": "Picks one.", "parameters": {"type": "object", "properties": {"names": {"type": "array"}, "flag": {"type": "boolean"}, "weight": {"type": "number"}}, "required": ["names"], "additionalProperties": false}}' AS told""")
def udf04_text(spark, d):
    return spark.range(1).select(F.lit(json.dumps(B.tool_schema(pick))).alias("told"))


@query("udf03_tool_registry", "SELECT * FROM (VALUES ('pick', 'found'), ('pick,nope', 'unknown tools: nope'), ('', 'found')) t(names, outcome)")
def udf03(spark, d):
    """An unknown name in a selection is an error that names it."""

    def outcome(names):
        try:
            B.Tools({"pick": pick}).select([n for n in names.split(",") if n])
            return "found"
        except KeyError as e:
            return e.args[0]

    return spark.createDataFrame([(n, outcome(n)) for n in ("pick", "pick,nope", "")], "names string, outcome string")


@query("udf13_sequential_backend", "SELECT conv_id, 'first' AS one, 'second' AS two FROM conversations WHERE turn = 0")
def udf13(spark, d):
    """A backend double that gives its replies in turn: the second call comes after a tool's result."""
    script = B.Scripted([B.Reply(calls=[("echo", {"x": "first"})]), B.Reply("second")])
    r = table(spark, d, "conversations").where("turn = 0").select("conv_id", B.generate(script, F.lit(""), F.col("text"), B.Tools({"echo": echo})).alias("r"))
    return r.select("conv_id", F.col("r.calls")[0].result.alias("one"), F.col("r.text").alias("two"))


def echo(x: str) -> str:
    return x


@query("prj47_tool_log", "SELECT conv_id, unnest([0, 1]) AS at, unnest(['echo', 'nope']) AS name, unnest(['{\"x\": \"a\"}', '{}']) AS arguments, unnest(['a', 'Error: unknown tool nope']) AS result FROM conversations WHERE turn = 0")
def prj47(spark, d):
    """Every call of a conversation with its arguments and result, in order."""
    script = B.Scripted([B.Reply(calls=[("echo", {"x": "a"}), ("nope", {})]), B.Reply("done")])
    r = table(spark, d, "conversations").where("turn = 0").select("conv_id", B.generate(script, F.lit(""), F.col("text"), B.Tools({"echo": echo})).alias("r"))
    return r.select("conv_id", F.posexplode("r.calls").alias("at", "c")).select("conv_id", "at", "c.*")


@query("hsh01_short_sha1", "SELECT doc_id, left(sha1(text), 8) AS version FROM documents")
def hsh01(spark, d):
    return documents(spark, d).select("doc_id", T.short_hash("text").alias("version"))


@query("hsh02_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hsh02(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("dat02_relative_days", "SELECT doc_id, CASE WHEN a <= 0 THEN 'today' WHEN a = 1 THEN 'yesterday' WHEN a < 7 THEN a || ' days ago' WHEN a // 7 = 1 THEN '1 week ago' WHEN a < 30 THEN (a // 7) || ' weeks ago' WHEN a // 30 = 1 THEN '1 month ago' ELSE (a // 30) || ' months ago' END AS age FROM (SELECT doc_id, doc_id % 100 - 2 AS a FROM documents)")
def dat02(spark, d):
    return documents(spark, d).select("doc_id", T.relative_time(F.col("doc_id") % 100 - 2).alias("age"))


def through_json(spark, df, schema, append=False):
    path = workspace.fresh(spark, "rows")
    sinks.json_lines(df, path)
    if append:
        sinks.json_lines(df, path, append=True)
    return readers.strict(spark, path, schema)


MESSAGES = "array<struct<role:string,content:string,thinking:string,name:string>>"


@query("src01_traces", "SELECT 't-' || conv_id AS id, count(*) AS messages, string_agg(text, '|' ORDER BY turn) AS said FROM conversations GROUP BY conv_id")
def src01(spark, d):
    """Also SNK01: whole conversations as strict JSON lines."""
    c = table(spark, d, "conversations")
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = c.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))
    back = through_json(spark, rows.select(F.concat(F.lit("t-"), "conv_id").alias("id"), "messages"), readers.TRACE)
    return back.select("id", F.size("messages").cast("long").alias("messages"), F.array_join(F.transform("messages", lambda x: F.coalesce(x.content, F.lit(""))), "|").alias("said"))


@query("src02_prompts", "SELECT 'p-' || doc_id AS id, source AS user_summary, 2 AS n_tools FROM documents")
def src02(spark, d):
    rows = documents(spark, d).select(F.concat(F.lit("p-"), "doc_id").alias("id"), F.col("source").alias("user_summary"), F.array(F.lit("recall"), F.col("lang")).alias("tools"))
    return through_json(spark, rows, readers.PROMPT).select("id", "user_summary", F.size("tools").alias("n_tools"))


@query("src03_memory_corpus", "SELECT CAST(doc_id AS VARCHAR) AS key, text AS value, lang AS tag, source AS archetype FROM documents")
def src03(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.array("lang").alias("tags"), F.col("source").alias("archetype"))
    return through_json(spark, rows, readers.MEMORY_CORPUS).select("key", "value", F.col("tags")[0].alias("tag"), "archetype")


@query("snk01_overwrite", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def snk01(spark, d):
    """A second write takes the place of the first."""
    path, rows = workspace.fresh(spark, "rows"), documents(spark, d).select("doc_id", "lang")
    sinks.json_lines(rows, path)
    sinks.json_lines(rows.where("lang = 'fr'"), path)
    return readers.strict(spark, path, "doc_id long, lang string")


@query("src07_all_suites", "SELECT lang AS suite, count(*) AS prompts FROM documents GROUP BY lang")
def src07(spark, d):
    """Also SNK04: without a choice of suites all folders are read."""
    path = workspace.fresh(spark, "suites")
    sinks.by_value(documents(spark, d).select("doc_id", F.col("lang").alias("suite")), path, "suite")
    return readers.by_suite(spark, path, "doc_id long").groupBy("suite").agg(F.count("*").alias("prompts"))


@query("snk04_suite_folders", "SELECT DISTINCT 'suite=' || lang AS folder FROM documents")
def snk04(spark, d):
    path = workspace.fresh(spark, "suites")
    sinks.by_value(documents(spark, d).select("doc_id", F.col("lang").alias("suite")), path, "suite")
    return spark.read.text(path, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), "/(suite=[^/]+)/", 1).alias("folder")).distinct()


@query("src10_flat_tolerant_ids", "SELECT DISTINCT 'p-' || doc_id AS id FROM documents WHERE doc_id % 4 <> 1")
def src10(spark, d):
    i = F.col("doc_id")
    line = F.when(i % 4 == 1, F.when(i % 8 == 1, F.lit('{"prompt_id"')).otherwise(F.lit('{"other": 1}'))).otherwise(F.concat(F.lit('{"prompt_id": "p-'), i.cast("string"), F.lit('"}')))
    path = workspace.fresh(spark, "ids")
    documents(spark, d).select(line.alias("value")).write.text(path)
    return readers.tolerant_ids(spark, path, "prompt_id")


@query("src11_generated_cache", "SELECT 'k' || (doc_id % 50) AS key, max(doc_id) AS seq, arg_max(text, doc_id) AS text FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")
def src11(spark, d):
    """A cache of generations: corrupt lines are passed over, the last of a key stands."""
    i, path = F.col("doc_id"), workspace.fresh(spark, "cache")
    row = F.to_json(F.struct(F.concat(F.lit("k"), (i % 50).cast("string")).alias("key"), i.alias("seq"), "text"))
    documents(spark, d).select(F.when(i % 7 == 0, F.lit('{"key": ')).otherwise(row).alias("value")).write.text(path)
    rows = spark.read.schema("key string, seq long, text string, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return readers.last_wins(rows.where("__bad is null and key is not null").drop("__bad"), "key", "seq")


@query("src19_reviews_by_image", "SELECT 'img' || (doc_id // 3) AS image, arg_max(lang, doc_id) AS review FROM documents GROUP BY 1")
def src19(spark, d):
    rows = documents(spark, d).select(F.concat(F.lit("img"), F.floor(F.col("doc_id") / 3).cast("string")).alias("image"), F.col("lang").alias("review"), F.col("doc_id").alias("seq"))
    return readers.last_wins(through_json(spark, rows, "image string, review string, seq long"), "image", "seq").select("image", "review")


@query("src20_take_order", "SELECT doc_id, doc_id % 7 AS pkna, doc_id % 5 AS conv, doc_id % 3 AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id % 7, doc_id % 5, doc_id % 3, doc_id) AS place FROM documents")
def src20(spark, d):
    """Takes sorted by the numbers in their names, not by the names."""
    from pyspark.sql.window import Window as W

    i = F.col("doc_id")
    name = F.format_string("take-pkna%d-conv%d-page%d.json", i % 7, i % 5, i % 3)
    rows = documents(spark, d).select("doc_id", "source", name.alias("file"))
    rows = rows.withColumns({k: F.regexp_extract("file", f"{k}(\\d+)", 1).cast("long") for k in ("pkna", "conv", "page")})
    return rows.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("pkna", "conv", "page", "doc_id")).cast("long")).drop("source", "file")


@query("src22_log_scan", "SELECT lang, count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def src22(spark, d):
    rows = through_json(spark, documents(spark, d).select("lang", "n_chars"), "lang string, n_chars long")
    return rows.groupBy("lang").agg(F.count("*").alias("calls"), F.sum("n_chars").alias("chars"))


@query("snk06_quoted_csv", "SELECT doc_id, lang, text FROM documents")
def snk06(spark, d):
    """All cells quoted; a list cell is JSON."""
    path = workspace.fresh(spark, "csv")
    sinks.csv_json(documents(spark, d).select("doc_id", F.array("lang", "text").alias("cell")), path)
    back = readers.csv_json(spark, path, {"cell": "array<string>"}, "doc_id long, cell string")
    return back.select("doc_id", F.col("cell")[0].alias("lang"), F.col("cell")[1].alias("text"))


@query("snk08_text_dataset", "SELECT text, count(*) AS n FROM conversations GROUP BY text")
def snk08(spark, d):
    """A dataset of one column ``text``."""
    path = workspace.fresh(spark, "dataset")
    table(spark, d, "conversations").select("text").write.parquet(path)
    return spark.read.parquet(path).groupBy("text").agg(F.count("*").alias("n"))


@query("snk17_operations_log", "SELECT CAST(n_nationkey AS BIGINT) AS step, unnest(['begin', 'end']) AS what FROM nation")
def snk17(spark, d):
    path, steps = workspace.fresh(spark, "log"), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("step"))
    for what in ("begin", "end"):
        sinks.json_lines(steps.withColumn("what", F.lit(what)), path, append=True)
    return readers.strict(spark, path, "step long, what string")


@query("snk05_file_per_entity", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def snk05(spark, d):
    root = workspace.fresh(spark, "entities")
    rows = table(spark, d, "nation").select(F.concat("n_name", F.lit(".json")).alias("path"), F.to_json(F.struct(F.col("n_nationkey").alias("id"))).alias("data"))
    archives.write_files(rows, root)
    back = spark.read.schema("id long").json(root)
    return back.select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json", 1).alias("name"), "id").withColumn("name", F.regexp_replace("name", "%20", " "))


@query("src17_system_prompt", "SELECT * FROM (VALUES ('own', 'You are calm.' || chr(10) || 'Stay so.'), ('other', 'You are loud.' || chr(10) || 'Stay so.')) t(kind, prompt)")
def src17(spark, d):
    """Also SNK13: template and profile files beside each other; another profile may take its place."""
    root = workspace.fresh(spark, "prompt")
    files = [("template.md", "You are {profile}.\nStay so."), ("profile.md", "calm"), ("loud.md", "loud")]
    archives.write_files(spark.createDataFrame(files, "path string, data string"), root)
    rows = [("own", readers.system_prompt(spark, root)), ("other", readers.system_prompt(spark, root, f"{root}/loud.md"))]
    return spark.createDataFrame(rows, "kind string, prompt string")


@query("src13_reflections", "SELECT n_name AS scene, CAST(n_regionkey AS BIGINT) AS mood FROM nation WHERE n_nationkey % 5 <> 0")
def src13(spark, d):
    """Two levels of folders, without ``meta``; broken files are left out."""
    root, n = workspace.fresh(spark, "reflections"), table(spark, d, "nation")
    whole = F.to_json(F.struct(F.col("n_name").alias("scene"), F.col("n_regionkey").alias("mood"), F.struct(F.lit("m").alias("model")).alias("meta")))
    rows = n.select(F.format_string("%d/%d.json", "n_regionkey", "n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, F.left(whole, F.lit(9))).otherwise(whole).alias("data"))
    archives.write_files(rows, root)
    return readers.reflections(spark, root, "scene string, mood long, meta struct<model:string>")


@query("src16_page_files", "SELECT 'i' || n_regionkey AS issue, CAST(n_nationkey AS BIGINT) AS page_num, n_name AS summary, CAST(n_nationkey % 3 AS BIGINT) AS panels FROM nation")
def src16(spark, d):
    """Typed page files, one JSON document each."""
    root, n = workspace.fresh(spark, "pages"), table(spark, d, "nation")
    panel = F.struct(F.lit(True).alias("is_new_scene"), F.lit("d").alias("description"))
    page = F.struct(F.col("n_name").alias("summary"), F.array_repeat(panel, (F.col("n_nationkey") % 3).cast("int")).alias("panels"))
    archives.write_files(n.select(F.format_string("i%d/page_%03d.json", "n_regionkey", "n_nationkey").alias("path"), F.to_json(page).alias("data")), root)
    return readers.pages(spark, root).select("issue", "page_num", "summary", F.size("panels").cast("long").alias("panels"))


@query("src24_download_resume", "SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey % 9 = 4 THEN 'failed' WHEN n_nationkey < 10 THEN 'there' ELSE 'fetched' END AS state FROM nation")
def src24(spark, d):
    """Two runs: the second finds what the first has written; addresses that give nothing stay open."""
    root = workspace.fresh(spark, "wiki")
    rows = table(spark, d, "nation").select(F.concat(F.lit("test://wiki/"), "n_nationkey").alias("url"), F.concat(F.lit("n"), "n_nationkey").alias("path"), "n_nationkey")
    archives.download(rows.where("n_nationkey < 10"), root, page_of).count()
    return archives.download(rows, root, page_of)


def page_of(url: str) -> bytes | None:
    """A stand-in for the network."""
    return None if int(url.rpartition("/")[2]) % 9 == 4 else url.encode()


@query("src27_unpack", "SELECT n_regionkey || '.cbz' AS archive, n_name || '.txt' AS name, n_name AS content FROM nation")
def src27(spark, d):
    root = workspace.fresh(spark, "cbz")
    rows = table(spark, d, "nation").select(F.concat("n_regionkey", F.lit(".cbz")).alias("archive"), F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").cast("binary").alias("data"))
    archives.write_archives(rows, root, "zip")
    return archives.unpack(spark, root).select(F.regexp_extract("archive", "([^/]+)$", 1).alias("archive"), "name", F.decode("data", "utf-8").alias("content"))


@query("snk19_backup", "SELECT source || '.tar.xz' AS archive, doc_id, md5(text) AS hash FROM documents")
def snk19(spark, d):
    """A compressed backup of each source's texts, read back."""
    root = workspace.fresh(spark, "backup")
    rows = documents(spark, d).select(F.concat("source", F.lit(".tar.xz")).alias("archive"), F.concat("doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("data"))
    archives.write_archives(rows, root)
    back = archives.unpack(spark, root)
    return back.select(F.regexp_extract("archive", "([^/]+)$", 1).alias("archive"), F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("doc_id"), F.md5("data").alias("hash"))


@query("jon02_filter_pending", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jon02(spark, d):
    labels = table(spark, d, "labels")
    return sinks.resume(labels, labels.where("toxic = 1"), ["doc_id"]).select("doc_id")


@query("jon04_scoring_pending", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 4)")
def jon04(spark, d):
    c = table(spark, d, "conversations")
    return sinks.resume(c.select("conv_id").distinct(), c.where("turn = 4").select("conv_id"), ["conv_id"])


@query("jon06_scene_reflection", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jon06(spark, d):
    return documents(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("jon10_file_metadata", "SELECT 'f' || n_nationkey AS file, r_name AS tag FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def jon10(spark, d):
    """Files with their tags, where they have any."""
    r = table(spark, d, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("tag"))
    return table(spark, d, "nation").join(r, "n_regionkey", "left").select(F.concat(F.lit("f"), "n_nationkey").alias("file"), "tag")


@query("jon12_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon12(spark, d):
    return sinks.resume(documents(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("jon16_variants", "SELECT n_name || '-' || v || '-' || l AS id FROM nation, (SELECT unnest(['A', 'B', 'C']) AS v), (SELECT unnest(['en', 'it']) AS l)")
def jon16(spark, d):
    variants = F.explode(F.array(*map(F.lit, "ABC"))).alias("v")
    both = table(spark, d, "nation").select("n_name", variants).select("n_name", "v", F.explode(F.array(F.lit("en"), F.lit("it"))).alias("l"))
    return both.select(F.concat_ws("-", "n_name", "v", "l").alias("id"))


@query("jon19_positional", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: length(x) % 5 <> 0) AS b FROM documents)
SELECT doc_id, i AS at, a[i] AS x, b[i] AS y, coalesce(a[i] = b[i], false) AS same FROM (SELECT doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM l)""")
def jon19(spark, d):
    """Lines compared by position, the longer list to its end."""
    a = F.split("text", "\n")
    zipped = F.arrays_zip(a.alias("x"), F.filter(a, lambda x: F.length(x) % 5 != 0).alias("y"))
    rows = documents(spark, d).select("doc_id", F.posexplode(zipped).alias("at", "z"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("at"), F.col("z.x").alias("x"), F.col("z.y").alias("y"), F.coalesce(F.col("z.x") == F.col("z.y"), F.lit(False)).alias("same"))


@query("set02_union_single_multi", "SELECT doc_id, 'single' AS kind FROM documents UNION ALL SELECT conv_id, 'multi' FROM conversations WHERE turn = 0")
def set02(spark, d):
    single = documents(spark, d).select("doc_id", F.lit("single").alias("kind"))
    return single.unionByName(table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.lit("multi").alias("kind")))


@query("set03_union_corpora", "SELECT doc_id AS id, 'seed' AS part FROM labels UNION ALL SELECT conv_id, 'roleplay' FROM conversations UNION ALL SELECT page_id, 'casual' FROM pages")
def set03(spark, d):
    part = lambda name, key, kind: table(spark, d, name).select(F.col(key).cast("long").alias("id"), F.lit(kind).alias("part"))
    return part("labels", "doc_id", "seed").unionByName(part("conversations", "conv_id", "roleplay")).unionByName(part("pages", "page_id", "casual"))


@query("set07_required_minus_present", "SELECT source, array_to_string(list_filter(['de', 'en', 'fr', 'xx'], lambda x: NOT list_contains(l, x)), ',') AS missing FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source)")
def set07(spark, d):
    need = F.array(*map(F.lit, ("de", "en", "fr", "xx")))
    s = documents(spark, d).groupBy("source").agg(F.collect_set("lang").alias("l"))
    return s.select("source", F.array_join(F.array_except(need, "l"), ",").alias("missing"))


@query("set08_set_equality", "SELECT a.conv_id FROM (SELECT conv_id, list_sort(list(DISTINCT role)) AS r FROM conversations GROUP BY conv_id) a WHERE r = ['assistant', 'user']")
def set08(spark, d):
    """Equal sets, whatever the order of what they were made of."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    want = F.array(F.lit("user"), F.lit("assistant"))
    return c.where((F.size(F.array_except("r", want)) == 0) & (F.size(F.array_except(want, "r")) == 0)).select("conv_id")


@query("top13_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY u, doc_id) AS place FROM (SELECT doc_id, (('0x' || substr(md5('s9|' || CAST(doc_id AS VARCHAR)), 1, 13))::UBIGINT / 4503599627370496::DOUBLE) AS u FROM documents) QUALIFY place <= 200")
def top13(spark, d):
    """A sample of 200 in its shuffled order."""
    from pyspark.sql.window import Window as W

    few = sampling.sample(documents(spark, d).select("doc_id"), 200, "s9", "doc_id")
    return few.select("doc_id", F.row_number().over(W.orderBy(T.uniform("s9", "doc_id"), "doc_id")).cast("long").alias("place"))


@query("prj15_structured_response", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id END AS id FROM documents")
def prj15(spark, d):
    """An object, or the first of a list; anything else gives null."""
    i = F.col("doc_id").cast("string")
    one = F.concat(F.lit('{"id": '), i, F.lit("}"))
    raw = F.when(F.col("doc_id") % 4 == 0, one).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("["), one, F.lit(', {"id": -1}]'))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise(F.lit("no json"))
    text = T.strip_fences(raw)
    first = F.coalesce(F.from_json(text, "array<struct<id:bigint>>")[0], F.from_json(text, "struct<id:bigint>"))
    return documents(spark, d).select("doc_id", first["id"].alias("id"))


@query("prj24_normalized_confidence", "SELECT doc_id, round(n_chars / max(n_chars) OVER (PARTITION BY source), 9) AS confidence FROM documents")
def prj24(spark, d):
    most = documents(spark, d).groupBy("source").agg(F.max("n_chars").alias("most"))
    rows = documents(spark, d).join(most, "source")
    return rows.select("doc_id", F.round(consensus.normalized_confidence(F.col("n_chars"), F.col("most")), 9).alias("confidence"))
