"""Column helpers for names and texts. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-cased texts that count as missing.
MISSING = ("", "null", "none", "n/a", "na", "nan")


def present(c: Column) -> Column:
    """Trimmed text, or null where it is missing by MISSING."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def norm(c: Column) -> Column:
    """Lower case; underscore, full stop and hyphen become spaces. lower() differs from case folding for a few letters (ß)."""
    return F.translate(F.lower(c), "_.-", "   ")


def norm_query(c: Column) -> Column:
    """norm() with white space collapsed."""
    return F.trim(F.regexp_replace(norm(c), r"\s+", " "))


def words(c: Column) -> Column:
    """Array of the non-empty runs of word characters, any script, lower-cased."""
    return F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda t: t != "")


def safe_token(c: Column, default: str = "field") -> Column:
    """ASCII identifier: lower case, other runs become one underscore, none at the ends."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^0-9a-z_]+", "_"), r"^_+|_+$", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def table_token(c: Column) -> Column:
    """Name of a table from a file or sheet name."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^0-9a-z]+", "_"), r"^_+|_+$", "")
    return F.when(t == "", F.lit("table")).otherwise(t)


def slug(c: Column) -> Column:
    """Identifier that keeps letters and digits of any script."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def join_text(*parts: Column) -> Column:
    """Parts joined by a space, without null and blank ones."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.trim(p) != ""), " ")


def ratio4(part: Column, whole: Column) -> Column:
    """part / whole to four decimals, half up; 0 of nothing. floor() gives the same digits in every engine."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / F.when(whole == 0, 1).otherwise(whole) * 10000 + F.lit(0.5)) / F.lit(10000.0))


def number(c: Column) -> Column:
    """The plain number a text holds, thousands separators ignored, or null."""
    t = F.replace(c, F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def day(c: Column) -> Column:
    """The date of a text in one of four forms: 2026-1-3, 2026/1/3, and the first with T or a space and a time."""
    return F.coalesce(
        F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d")),
        F.when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(c, "yyyy/M/d")),
        F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}$"), F.try_to_date(F.substring_index(F.replace(c, F.lit("T"), F.lit(" ")), " ", 1), "yyyy-M-d")),
    )
