"""Queries over conversations: scenes, runs, chat records, length rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, sequence
from .base import query, table

WORDS = "len(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"
EST = WORDS + " * 13 // 10"


def conversations(spark, d):
    return table(spark, d, "conversations")


def merged_roles(df):
    return df.withColumn("speaker", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))


LENGTH_SQL = f"""WITH r AS (SELECT conv_id, coalesce(bool_and({EST.format('text')} BETWEEN {{}} AND {{}}) FILTER (role = 'assistant' AND text <> ''), false) AS ok FROM conversations GROUP BY conv_id)
SELECT ok AS length_ok, count(*) AS n FROM r GROUP BY ok"""


@query("flt02_response_length", LENGTH_SQL.format(10, 500))
def flt02(spark, d):
    return chat.collect_messages(conversations(spark, d)).groupBy(chat.length_ok().alias("length_ok")).agg(F.count("*").alias("n"))


@query("flt02_response_length_tight", LENGTH_SQL.format(10, 60))
def flt02_tight(spark, d):
    return chat.collect_messages(conversations(spark, d)).groupBy(chat.length_ok(high=60).alias("length_ok")).agg(F.count("*").alias("n"))


@query("agg32_pass_rate", f"""WITH r AS (SELECT conv_id, coalesce(bool_and({EST.format('text')} BETWEEN 10 AND 60) FILTER (role = 'assistant' AND text <> ''), false) AS ok FROM conversations GROUP BY conv_id)
SELECT count(*) AS total, CAST(sum(ok::int) AS BIGINT) AS passed, round(avg(ok::int), 6) AS rate FROM r""")
def agg32(spark, d):
    ok = chat.collect_messages(conversations(spark, d)).select(chat.length_ok(high=60).cast("int").alias("ok"))
    return ok.agg(F.count("*").alias("total"), F.sum("ok").alias("passed"), F.round(F.avg("ok"), 6).alias("rate"))


@query("str02_token_estimate", f"SELECT conv_id, turn, {EST.format('text')} AS tokens FROM conversations")
def str02(spark, d):
    return conversations(spark, d).select("conv_id", "turn", T.token_estimate("text").alias("tokens"))


@query("win01_flag_sessions", """WITH s AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events))
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL""")
def win01(spark, d):
    s = sequence.sessions_by_flag(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("win02_scene_index", """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
g AS (SELECT user_id, session, CAST(min(event_id) AS BIGINT) AS first, min(ts)::date AS day, bool_or(event_type = 'purchase') AS has FROM s GROUP BY ALL)
SELECT user_id, first, row_number() OVER (PARTITION BY user_id, day ORDER BY session) - 1 AS scene_index FROM g WHERE has""")
def win02(spark, d):
    s = sequence.sessions_by_flag(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    g = s.groupBy("user_id", "session").agg(F.min("event_id").alias("first"), F.to_date(F.min("ts")).alias("day"), F.bool_or(F.col("event_type") == "purchase").alias("has")).where("has")
    return sequence.scene_index(g, ["user_id", "day"], ["session"]).select("user_id", "first", "scene_index")


@query("win03_gap_sessions", """WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', ts::date) AS BIGINT) AS day FROM events),
s AS (SELECT *, sum(CASE WHEN day - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS session FROM (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM p))
SELECT user_id, CAST(session AS BIGINT) AS session, min(day) AS first, max(day) AS last, count(*) AS pages FROM s GROUP BY ALL""")
def win03(spark, d):
    pages = table(spark, d, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    s = sequence.sessions_by_gap(pages, ["user_id"], "day")
    return s.groupBy("user_id", "session").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("pages"))


@query("win04_present_runs", """WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', ts::date) AS BIGINT) AS day FROM events WHERE event_type = 'click'),
r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM p)
SELECT user_id, min(day) AS first, max(day) AS last FROM r GROUP BY user_id, run""")
def win04(spark, d):
    pages = table(spark, d, "events").where("event_type = 'click'").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    return sequence.present_runs(pages, ["user_id"], "day").groupBy("user_id", "run").agg(F.min("day").alias("first"), F.max("day").alias("last")).drop("run")


@query("win05_speaker_runs", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, count(*) AS merged, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) AS text FROM r GROUP BY ALL""")
def win05(spark, d):
    e = table(spark, d, "events").withColumn("text", F.col("event_id").cast("string"))
    return sequence.merge_runs(e, ["user_id"], "event_id", "event_type", "text")


ROLE_RUNS = """a AS (SELECT conv_id, turn, text, CASE WHEN role = 'system' THEN 'user' ELSE role END AS speaker FROM conversations),
b AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS s FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM b),
m AS (SELECT conv_id, run, speaker, min(turn) AS first, count(*) AS merged, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, speaker)"""


@query("win06_role_merge", f"WITH {ROLE_RUNS} SELECT * FROM m")
def win06(spark, d):
    return sequence.merge_runs(merged_roles(conversations(spark, d)), ["conv_id"], "turn", "speaker", "text")


@query("win07_chat_opener", f"""WITH {ROLE_RUNS},
c AS (SELECT *, max(run) OVER (PARTITION BY conv_id) AS last FROM m),
k AS (SELECT conv_id, run + 1 AS pos, speaker, text FROM c WHERE NOT (run = last AND speaker = 'user') UNION ALL SELECT conv_id, 0, 'user', '...' FROM c WHERE run = 0 AND speaker = 'assistant')
SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY pos) AS chat FROM k GROUP BY conv_id""")
def win07(spark, d):
    m = sequence.merge_runs(merged_roles(conversations(spark, d)), ["conv_id"], "turn", "speaker", "text")
    c = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "speaker", "text"))).alias("m"))
    opened = F.when(F.element_at("m", 1).speaker == "assistant", F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("run"), F.lit("user").alias("speaker"), F.lit("...").alias("text"))), "m")).otherwise(F.col("m"))
    kept = c.withColumn("m", opened).withColumn("m", F.when(F.element_at("m", -1).speaker == "user", F.slice("m", F.lit(1), F.size("m") - 1)).otherwise(F.col("m")))
    return kept.where(F.size("m") > 0).select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x.speaker, F.lit(": "), x.text)), "\n").alias("chat"))


@query("win08_trim", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
b AS (SELECT *, min(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS lo, max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS hi FROM a)
SELECT conv_id, turn, role FROM b WHERE pos BETWEEN lo - 1 AND hi""")
def win08(spark, d):
    return sequence.trim_to(conversations(spark, d), ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", "role")


@query("win09_page_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents")
def win09(spark, d):
    return sequence.numbered(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "page").select("doc_id", "page")


@query("win10_prior_context", """WITH a AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN CAST(event_id AS VARCHAR) ELSE '' END AS v FROM events),
b AS (SELECT user_id, event_id, array_agg(v) FILTER (v <> '') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM a)
SELECT user_id, event_id, coalesce(array_to_string(l[greatest(len(l) - 2, 1):], ','), '') AS prior FROM b""")
def win10(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type").isin("click", "purchase"), F.col("event_id").cast("string")).otherwise(""))
    return sequence.last_non_empty(e, ["user_id"], ["event_id"], "v", 3, "l").select("user_id", "event_id", F.array_join("l", ",").alias("prior"))


@query("win11_events_so_far", """WITH a AS (SELECT conv_id, list(CAST(turn AS VARCHAR) || role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(l[1:3], ',') AS so_far FROM a""")
def win11(spark, d):
    a = chat.collect_messages(conversations(spark, d))
    return a.select("conv_id", F.array_join(F.transform(F.slice("messages", 1, 3), lambda m: F.concat(m.turn.cast("string"), m.role)), ",").alias("so_far"))


@query("win12_turn_prefix", """SELECT a.conv_id, a.turn, md5(string_agg('[' || b.role || '] ' || b.text, chr(10) ORDER BY b.turn)) AS prefix
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn""")
def win12(spark, d):
    """Also PRJ13: the rendered prefix up to each scored turn."""
    a = chat.collect_messages(conversations(spark, d)).select("conv_id", "messages", F.posexplode("messages").alias("i", "m")).where("m.role = 'assistant'")
    return a.select("conv_id", "m.turn", F.md5(chat.render(F.slice("messages", F.lit(1), F.col("i") + 1))).alias("prefix"))


@query("win13_carry_forward", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_event FROM events""")
def win13(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return sequence.carry_forward(e, ["user_id"], ["event_id"], "v", "last_event").select("user_id", "event_id", "last_event")


@query("win15_spread", """SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 60 / greatest(count(*) OVER (PARTITION BY source) - 1, 1)) AS BIGINT) AS days_ago FROM documents""")
def win15(spark, d):
    return sequence.spread(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id").select("doc_id", "days_ago")


@query("win16_directives", """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'continue' WHEN 1 THEN ['probe', 'joke'][turn % 2 + 1] ELSE ['probe', 'joke', 'leave'][turn % 3 + 1] END AS directive FROM conversations""")
def win16(spark, d):
    items = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 1, F.array(F.lit("probe"), F.lit("joke"))).otherwise(F.array(F.lit("probe"), F.lit("joke"), F.lit("leave")))
    return conversations(spark, d).select("conv_id", "turn", sequence.cycle(items, F.col("turn"), "continue").alias("directive"))


@query("win18_version_chain", """SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS after FROM events""")
def win18(spark, d):
    from pyspark.sql.window import Window as W

    return table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")).alias("before"), F.col("event_type").alias("after"))


@query("flt01_target_speaker", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(lower(role) = 'system')")
def flt01(spark, d):
    return conversations(spark, d).groupBy("conv_id").agg(F.bool_or(F.lower("role") == "system").alias("has")).where("has").select("conv_id")


@query("prj01_flatten", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role, length(text) AS n FROM conversations""")
def prj01(spark, d):
    """Nested rows flattened with their positions."""
    return chat.collect_messages(conversations(spark, d)).select("conv_id", F.posexplode("messages").alias("pos", "m")).select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", F.length("m.content").cast("long").alias("n"))


@query("prj02_dialogue_defaults", """SELECT conv_id, turn, trim(role) AS speaker, coalesce(CASE WHEN turn % 2 = 1 THEN role END, 'neutral') AS tone, 'informing' AS speech_act FROM conversations WHERE trim(text) <> '' AND trim(role) <> ''""")
def prj02(spark, d):
    c = conversations(spark, d).withColumn("tone", F.when(F.col("turn") % 2 == 1, F.col("role"))).withColumn("act", F.lit(None).cast("string"))
    return c.where((F.trim("text") != "") & (F.trim("role") != "")).select("conv_id", "turn", F.trim("role").alias("speaker"), F.coalesce("tone", F.lit("neutral")).alias("tone"), F.coalesce("act", F.lit("informing")).alias("speech_act"))


@query("prj05_trace_messages", """SELECT conv_id, count(*) + 1 AS n, md5('system: You are a guide.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id""")
def prj05(spark, d):
    a = chat.collect_messages(conversations(spark, d)).withColumn("m", chat.with_system("messages", F.lit("You are a guide.")))
    return a.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n")).alias("h"))


@query("prj06_convert_message", """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN turn % 4 <> 0 AND role = 'assistant' AND turn % 3 = 1 THEN left(text, 9) END AS reasoning_content, CASE WHEN turn % 4 <> 0 THEN 'n' || turn END AS name FROM conversations""")
def prj06(spark, d):
    c = conversations(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, "tool").otherwise(F.col("role")).alias("role"), "text", F.when(F.col("turn") % 3 == 1, F.left("text", F.lit(9))).otherwise("").alias("thinking"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("name"))
    a = chat.collect_messages(c, "conv_id", "turn", "thinking", "name")
    return a.select("conv_id", F.arrays_zip(F.transform("messages", lambda m: m.turn).alias("turn"), chat.converted("messages").alias("m")).alias("z")).select("conv_id", F.inline("z")).select("conv_id", "turn", "m.role", "m.reasoning_content", "m.name")


@query("prj07_tool_calls", """SELECT conv_id, turn, '[{"function":{"name":"recall","arguments":{"turn":' || turn || '}}}]' AS calls FROM conversations WHERE role = 'assistant'""")
def prj07(spark, d):
    calls = F.array(F.struct(F.lit("recall").alias("name"), F.struct("turn").alias("arguments")))
    converted = F.transform(calls, lambda c: F.struct(F.struct(c["name"].alias("name"), c.arguments.alias("arguments")).alias("function")))
    return conversations(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.to_json(converted).alias("calls"))


@query("prj08_visible_messages", "SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id")
def prj08(spark, d):
    return chat.collect_messages(conversations(spark, d)).select("conv_id", F.size(chat.visible()).cast("long").alias("n")).where("n > 0")


@query("prj09_visible_responses", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS replies FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY conv_id")
def prj09(spark, d):
    a = chat.collect_messages(conversations(spark, d)).withColumn("v", chat.visible("messages", ("assistant",)))
    return a.where(F.size("v") > 0).select("conv_id", F.array_join(F.transform("v", lambda m: m.content), "\n").alias("replies"))


@query("prj10_prepend_context", """WITH f AS (SELECT conv_id, min(turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, md5(CASE WHEN c.turn = f.u THEN '[User]' || chr(10) || 'user ' || c.conv_id || chr(10) || chr(10) || text ELSE text END) AS h FROM conversations c LEFT JOIN f USING (conv_id)""")
def prj10(spark, d):
    """Also PRJ11: the preamble leaves out the empty memory block."""
    context = chat.preamble(F.concat(F.lit("user "), F.col("conv_id").cast("string")), F.lit(""))
    a = chat.collect_messages(conversations(spark, d))
    return a.select("conv_id", F.inline(chat.prepend_context("messages", context))).select("conv_id", "turn", F.md5("content").alias("h"))


@query("prj12_judge_text", """SELECT conv_id, md5(string_agg('[' || CASE WHEN turn % 4 = 0 THEN 'tool' ELSE role END || '] ' || CASE WHEN turn % 4 = 0 AND length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id""")
def prj12(spark, d):
    c = conversations(spark, d).withColumn("role", F.when(F.col("turn") % 4 == 0, "tool").otherwise(F.col("role")))
    return chat.collect_messages(c).select("conv_id", F.md5(chat.render(F.col("messages"))).alias("h"))


@query("prj23_question_pairs", """WITH a AS (SELECT conv_id, row_number() OVER w - 1 AS pos, text, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, pos, md5(text) AS q, md5(answer) AS a FROM a WHERE pos % 2 = 0 AND contains(text, ',') AND answer IS NOT NULL""")
def prj23(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    a = conversations(spark, d).select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "text", F.lead("text").over(w).alias("answer"))
    return a.where((F.col("pos") % 2 == 0) & F.contains("text", F.lit(",")) & F.col("answer").isNotNull()).select("conv_id", "pos", F.md5("text").alias("q"), F.md5("answer").alias("a"))


@query("prj43_suite_prompt", """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'memory' ELSE 'full' END AS template FROM (SELECT DISTINCT conv_id FROM conversations)""")
def prj43(spark, d):
    templates = F.create_map(F.lit("s0"), F.lit("minimal"), F.lit("s1"), F.lit("memory"))
    c = conversations(spark, d).select("conv_id").distinct()
    return c.select("conv_id", F.coalesce(F.try_element_at(templates, F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string"))), F.lit("full")).alias("template"))


@query("prj44_simulator_messages", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Go on.' WHEN 1 THEN 'Ask a question.' ELSE 'Go on.' END || ' ' || md5(text) AS prompt FROM conversations WHERE role = 'user'""")
def prj44(spark, d):
    known = F.create_map(F.lit("d0"), F.lit("Go on."), F.lit("d1"), F.lit("Ask a question."))
    directive = F.coalesce(F.try_element_at(known, F.concat(F.lit("d"), (F.col("turn") % 3).cast("string"))), F.element_at(known, F.lit("d0")))
    return conversations(spark, d).where("role = 'user'").select("conv_id", "turn", F.concat(directive, F.lit(" "), F.md5("text")).alias("prompt"))


CHATML = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)"


@query("udf12_chat_render", f"SELECT conv_id, md5({CHATML}) AS h, {EST.format(CHATML)} AS tokens FROM conversations GROUP BY conv_id")
def udf12(spark, d):
    a = chat.collect_messages(conversations(spark, d)).withColumn("text", chat.chat_template(F.col("messages")))
    return a.select("conv_id", F.md5("text").alias("h"), T.token_estimate("text").alias("tokens"))


@query("flt07_max_length", f"WITH t AS (SELECT conv_id, {EST.format(CHATML)} AS tokens FROM conversations GROUP BY conv_id) SELECT conv_id FROM t WHERE tokens <= 512")
def flt07(spark, d):
    return udf12(spark, d).where("tokens <= 512").select("conv_id")


@query("agg11_length_percentiles", f"""WITH t AS (SELECT conv_id, {EST.format(CHATML)} AS tokens FROM conversations GROUP BY conv_id)
SELECT count(*) AS n, min(tokens) AS lo, max(tokens) AS hi, round(avg(tokens), 6) AS mean, round(quantile_cont(tokens, 0.5), 6) AS median, round(quantile_cont(tokens, 0.95), 6) AS p95, round(quantile_cont(tokens, 0.99), 6) AS p99 FROM t""")
def agg11(spark, d):
    p = lambda q: F.round(F.percentile("tokens", F.lit(q)), 6)
    return udf12(spark, d).agg(F.count("*").alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.round(F.avg("tokens"), 6).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("udf14_tool_groups", """WITH a AS (SELECT *, turn % 3 <> 0 AS tool FROM conversations), b AS (SELECT *, CASE WHEN lag(tool) OVER w IS NOT DISTINCT FROM tool OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS s FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM b) SELECT conv_id, run, count(*) AS n FROM r WHERE tool GROUP BY conv_id, run""")
def udf14(spark, d):
    a = conversations(spark, d).withColumn("tool", F.col("turn") % 3 != 0)
    return sequence.runs(a, ["conv_id"], ["turn"], "tool").where("tool").groupBy("conv_id", "run").agg(F.count("*").alias("n"))
