"""Markdown segmentation, greedy chunking and line-wise section edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def segments(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """Segments at ## and ### headings with their heading path (PRJ30, PRJ33).

    # and #### lines are content; a heading without a line behind it gives no
    segment; ### is forgotten at the next ##.
    """
    lines = files.select(F.col(path).alias("file_path"), F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    level = F.when(F.col("line").rlike(r"^##\s+."), 2).when(F.col("line").rlike(r"^###\s+."), 3)
    marked = lines.withColumns({"level": level, "title": F.when(level.isNotNull(), F.trim(F.regexp_replace("line", r"^#{2,3}\s+", "")))})
    w = W.partitionBy("file_path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumns({
        "island": F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w),
        "h2": F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(w),
        "h3": F.last(F.when(F.col("level") == 2, F.lit("")).when(F.col("level") == 3, F.col("title")), ignorenulls=True).over(w),
    })
    body = marked.where("level is null").groupBy("file_path", "island").agg(
        F.max("h2").alias("h2"), F.max("h3").alias("h3"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("content"),
    )
    section = F.filter(F.array("h2", "h3"), lambda x: x.isNotNull() & (x != ""))
    deep = F.when(F.col("h3") != "", 3).when(F.col("h2").isNotNull(), 2).otherwise(1).cast("long")
    kept = body.select("file_path", F.col("island").alias("segment"), section.alias("section_path"), deep.alias("level"), F.btrim("content", F.lit(" \n\t\r")).alias("content"))
    return kept.withColumns({
        "segment_id": F.array_join(F.concat(F.array("file_path"), "section_path"), "::"),
        "level": F.col("level"),
        "token_count": T.token_estimate("content"),
    })


def blocks(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """Paragraphs and fenced blocks in order, each with the heading path above it (PRJ31).

    Blank lines part paragraphs; a fence (``` or ~~~) runs to its end, blank
    lines and headings included; an open one runs to the end of the file.
    Headings of all six levels stand on the path and are no blocks.
    """
    lines = files.select(F.col(path).alias("file_path"), F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    w = W.partitionBy("file_path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    fences = F.sum(F.when(mark, 1).otherwise(0)).over(w)
    lines = lines.withColumns({"mark": mark, "fences": fences}).withColumn("fenced", F.col("mark") | (F.col("fences") % 2 == 1))
    level = F.when(~F.col("fenced"), F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.btrim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    for n in range(1, 7):
        # A heading of a lower number forgets the deeper ones.
        lines = lines.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.col("title")).when(F.col("level") < n, F.lit("")), ignorenulls=True).over(w))
    blank = ~F.col("fenced") & (F.btrim("line") == "")
    starts = F.col("level").isNotNull() | blank | (F.col("mark") & (F.col("fences") % 2 == 1))
    after_fence = F.coalesce(F.lag(F.col("mark") & (F.col("fences") % 2 == 0)).over(W.partitionBy("file_path").orderBy("pos")), F.lit(False))
    lines = lines.withColumn("block", F.sum(F.when(starts | after_fence, 1).otherwise(0)).over(w)).where(F.col("level").isNull() & ~blank)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    found = lines.groupBy("file_path", "block").agg(F.min("pos").alias("pos"), F.bool_or("fenced").alias("fenced"), text.alias("text"), *(F.max(f"h{n}").alias(f"h{n}") for n in range(1, 7)))
    headings = F.filter(F.array(*(f"h{n}" for n in range(1, 7))), lambda x: x.isNotNull() & (x != ""))
    return found.select("file_path", "pos", "fenced", "text", headings.alias("headings"))


def compact(df: DataFrame, key: str, order: str, text: str, least: int, most: int) -> DataFrame:
    """Greedy chunks of consecutive texts of up to ``most`` characters; a tail of at most ``least`` is dropped (PRJ32)."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a, x):
        joined = F.when(a.now == "", x).otherwise(F.concat(a.now, F.lit("\n\n"), x))
        over = (a.now != "") & (F.length(joined) > most)
        return F.struct(F.when(over, F.array_append(a.done, a.now)).otherwise(a.done).alias("done"), F.when(over, x).otherwise(joined).alias("now"))

    folded = df.groupBy(key).agg(texts.alias("t")).withColumn(
        "c", F.aggregate("t", start, add, lambda a: F.when(F.length(a.now) > least, F.array_append(a.done, a.now)).otherwise(a.done)))
    return folded.select(key, F.posexplode("c").alias("chunk", "content"))


def headers(text: Column | str) -> Column:
    """Distinct ## headings of a text (PRJ35)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^## (.+)$"), F.lit(1)))


def edit_lines(lines: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines (doc_id, line_no, line) after edits (doc_id, find, op, put); an edit applies only where its text is one line (PRJ45, STR12).

    op is replace, delete or add (behind the line).
    """
    hits = lines.join(edits, key).where(F.lower(F.trim("line")) == F.lower(F.trim("find"))).select(key, "line_no", "op", "put")
    single = hits.groupBy(key, "op", "put").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no")).where("n = 1").drop("n")
    out = lines.join(single, [key, "line_no"], "left")
    base = out.where("op is null or op <> 'delete'").select(key, "line_no", F.lit(0).alias("sub"), F.when(F.col("op") == "replace", F.col("put")).otherwise(F.col("line")).alias("line"))
    added = out.where("op = 'add'").select(key, "line_no", F.lit(1).alias("sub"), F.col("put").alias("line"))
    w = W.partitionBy(key).orderBy("line_no", "sub")
    return base.unionByName(added).select(key, (F.row_number().over(w) - 1).cast("long").alias("line_no"), "line")
