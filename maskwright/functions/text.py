"""Column expressions on text: match spans, line numbers, literals, SQL-looking strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<start:int,len:int,value:string>"
#: What a string must begin with, in any case and after white space, to count as SQL. Fixed values.
SQL_STARTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "EXEC", "EXECUTE", "WITH", "MERGE", "DECLARE", "BEGIN")


def unicode_pattern(pattern: str) -> str:
    """Word characters, digits and borders by Unicode, in Java's dialect."""
    return f"(?U){pattern}"


def hits(text: Column, pattern: str) -> Column:
    """All matches, left to right without overlap, as (start from 0, length, value) in code points.

    The pattern must match at least one character wherever it matches; a null text has no hits. A start is the length of
    the stretches and matches before it, carried along in one fold over both.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("got"))

    def step(acc, x):
        start, n = acc["at"] + F.length(x["gap"]), F.length(x["hit"])
        one = F.struct(start.alias("start"), n.alias("len"), x["hit"].alias("value"))
        return F.struct((start + n).alias("at"), F.array_append(acc["got"], one).alias("got"))

    rows = F.arrays_zip(found.alias("hit"), gaps.alias("gap"))
    return F.when(text.rlike(pattern), F.aggregate(rows, zero, step, lambda a: a["got"])).otherwise(F.array().cast(f"array<{HIT}>"))


def line_of(text: Column, start: Column) -> Column:
    """1-based line of an offset."""
    return F.size(F.split(F.substring(text, F.lit(1), start), "\n", -1))


def looks_like_sql(text: Column) -> Column:
    return (F.length(text) >= 10) & F.upper(F.ltrim(text)).rlike(f"^({'|'.join(SQL_STARTS)}) ")


def literal_inner(literal: Column) -> Column:
    """What stands in a quoted SQL literal, doubled quotes undone; other text as it is."""
    body = F.regexp_extract(literal, r"(?s)^[Nn]?'(.*)'$", 1)
    return F.when(literal.rlike(r"(?s)^[Nn]?'.*'$"), F.replace(body, F.lit("''"), F.lit("'"))).otherwise(literal)


def is_numeric_or_date(value: Column) -> Column:
    """Numbers (signs, thousands, exponents) and dates, which are no sensitive literals."""
    number = F.regexp_replace(F.trim(value), r"[,$]", "")
    return F.coalesce(number.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") | F.regexp_like(value, F.lit(r"^\d{4}[-/]\d{2}[-/]\d{2}")) | F.regexp_like(F.trim(value), F.lit(r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$")), F.lit(False))


def is_number_like(value: Column) -> Column:
    """Whole numbers and dates with room around, which source literals may show as they are."""
    return value.rlike(r"(?i)^(?:\s*[+-]?[\d,]*\.?\d+(e[+-]?\d+)?\s*$|\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|\d{1,2}-[A-Za-z]{3}-\d{2,4}$)")
