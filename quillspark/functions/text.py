"""Scalar text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x) -> Column:
    """Lower-cased pieces between Unicode white space (STR01)."""
    return F.array_remove(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)\s+"), "")


def token_estimate(x) -> Column:
    """1.3 tokens a word, cut to an integer (STR02)."""
    return F.expr("0L") + F.floor(F.size(tokens(x)).cast("long") * 13 / 10)


def strip_quotes(x) -> Column:
    """Without blanks, then double quotes, at both ends (STR04)."""
    return F.btrim(F.btrim(_c(x)), F.lit('"'))


def truncate(x, n: int, mark: str = "...") -> Column:
    """At most n characters, then a mark if any were cut (STR05)."""
    return F.when(F.length(_c(x)) > n, F.concat(F.left(_c(x), F.lit(n)), F.lit(mark))).otherwise(_c(x))


def occurrences(x, part) -> Column:
    """Times that a literal occurs, without overlap (STR06)."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(part) > 0, ((F.length(_c(x)) - F.length(F.replace(_c(x), part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def slug(x) -> Column:
    """Lower-case id of letters and digits joined by dashes; one pass over double dashes (PRJ20)."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]", "-")
    return F.btrim(F.replace(kept, F.lit("--"), F.lit("-")), F.lit("-"))


def strip_fences(x) -> Column:
    """The inside of a fenced block, or the text itself (PRJ14)."""
    text = F.btrim(_c(x), F.lit(" \n\t\r"))
    return F.when(text.startswith("```"), F.btrim(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```$", ""), F.lit(" \n\t\r"))).otherwise(text)


def signed(x) -> Column:
    """[+n], [0] or [-n] (STR11)."""
    return F.concat(F.lit("["), F.when(_c(x) > 0, F.lit("+")).otherwise(F.lit("")), _c(x).cast("string"), F.lit("]"))


def base_and_variant(x) -> tuple[Column, Column]:
    """What stands before and behind the last dash (STR09)."""
    return F.regexp_extract(_c(x), r"^(.*)-([^-]*)$", 1), F.substring_index(_c(x), "-", -1)


def relative_time(days) -> Column:
    """Age in days as words (PRJ26)."""
    d = _c(days)

    def some(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (
        F.when(d <= 0, F.lit("today")).when(d == 1, F.lit("yesterday")).when(d < 7, some(d, "day"))
        .when(d < 30, some(F.floor(d / 7), "week")).otherwise(some(F.floor(d / 30), "month"))
    )


def natural_key(x) -> Column:
    """Dash-separated parts, numbers padded so that they sort by value (TOP07)."""
    return F.array_join(F.transform(F.split(_c(x), "-"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(F.concat(F.lit("~"), p))), "-")


def uniform(seed: str, key) -> Column:
    """A reproducible uniform number in [0, 1) from a seed and a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), _c(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def short_hash(x, n: int = 8) -> Column:
    """The first characters of a SHA-1 (HSH01)."""
    return F.left(F.sha1(_c(x)), F.lit(n))


def bpe_count(x, encode) -> Column:
    """Tokens by an injected encoder, a picklable callable str -> list (STR03)."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t)) if t else 0 for t in texts])

    return count(_c(x))


def stamp(format: str = "yyyyMMdd-HHmmss") -> Column:
    """The current time as a name (DAT01)."""
    return F.date_format(F.current_timestamp(), format)
