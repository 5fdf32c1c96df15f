"""Line rule: the separators and edge cases of Python's ``str.splitlines``, as Spark column expressions.

A text of n lines gives n items; one final separator does not open an empty line; ``\r\n`` is one separator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line separators of Python's str.splitlines, as a Java regular expression.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# Once "\r\n" is replaced by "\n", every separator is one character of this class.
LINE_BREAK_CHAR = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# The same rule for DuckDB (RE2) in oracle SQL.
LINE_BREAK_SQL = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_lines(text: Column | str) -> Column:
    """ARRAY<STRING> of lines; ``""`` gives an empty array.

    ``\r\n`` is first turned into ``\n`` by a literal replace, so the split runs on a single character class
    (no alternation tried at every position), and one final separator is cut by looking at the last character.
    """
    t = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    last_is_break = F.substring(t, -1, 1).rlike(f"^{LINE_BREAK_CHAR}$")
    body = F.when(last_is_break, t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK_CHAR, -1))


def first_line(text: Column | str) -> Column:
    """The first item of :func:`split_lines`, ``""`` where there is none (an empty or null text).

    Reads up to the first separator only, and never looks into an array that may be empty, which ANSI mode forbids."""
    until_break = f"^[^{LINE_BREAK_CHAR[1:]}*"
    return F.coalesce(F.regexp_extract(_c(text), until_break, 0), F.lit(""))


def line_count(text: Column | str) -> Column:
    return F.size(split_lines(text))


def newline_count(text: Column | str) -> Column:
    t = _c(text)
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def flatten_newlines(text: Column | str) -> Column:
    """``\\n`` → space, as done before any text is embedded."""
    return F.replace(_c(text), F.lit("\n"), F.lit(" "))


def split_lines_sql(expr: str) -> str:
    """DuckDB expression with the same result as :func:`split_lines`."""
    stripped = f"regexp_replace({expr}, '(?:{LINE_BREAK_SQL})$', '')"
    return f"(CASE WHEN {expr} = '' THEN []::VARCHAR[] ELSE string_split_regex({stripped}, '{LINE_BREAK_SQL}') END)"
