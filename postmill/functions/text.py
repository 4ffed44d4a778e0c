"""Text columns. Everything here is a built-in expression: no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the tables treat as blank. Spark's own trim knows the space
# only and its \s is ASCII, so both are given explicitly.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def text(c: Column | str) -> Column:
    """Null is the empty string at the table boundary."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def squash(c: Column | str) -> Column:
    """Blank runs become one space; none is left at either end."""
    return F.btrim(F.regexp_replace(as_col(c), BLANK_RUN, " "), F.lit(" "))


def drop_trailing_slashes(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit("/"))


def non_empty(c: Column | str) -> Column:
    """Null for the empty string, so that coalesce can pick the first filled value."""
    return F.nullif(as_col(c), F.lit(""))


def lenient_int(c: Column | str) -> Column:
    return F.coalesce(strip(text(c)).try_cast("bigint"), F.lit(0).cast("bigint"))


def has_any(c: Column, phrases: list[str]) -> Column:
    """True where the text holds one of a short, fixed list of phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p)
    return found


def matches_any(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """One alternation instead of one regex run per rule."""
    flags = "(?iu)" if ignore_case else ""
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def unfence(reply: Column | str) -> Column:
    """A reply without its code fence and the first `json` after it."""
    r = strip(text(reply))
    inside = F.regexp_replace(F.btrim(r, F.lit("`")), r"(?s)^(.*?)json", "$1")
    return F.when(r.startswith("```"), strip(inside)).otherwise(r)


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")


def eastern_text(ts: Column | str) -> Column:
    """UTC TIMESTAMP_NTZ -> `YYYY-MM-DD HH:MM:SS EST|EDT`, whatever the session zone."""
    utc = as_col(ts).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc)
    behind = F.timestamp_diff("HOUR", local, utc)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
        F.when(behind == 4, F.lit(" EDT")).otherwise(F.lit(" EST")),
    )
