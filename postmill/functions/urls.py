"""URL columns: splitting, resolving against a base, canonical forms, variants.

All of it is built-in expressions, so it stays in the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import (
    as_col, drop_trailing_slashes, has_any, matches_any, strip, text,
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(as_col(url), 1))


def host(url: Column | str) -> Column:
    return _part(as_col(url), 2)


def path(url: Column | str) -> Column:
    """Path without the `;parameters` of its last segment."""
    return F.regexp_replace(_part(as_col(url), 3), ";[^/]*$", "")


def query(url: Column | str) -> Column:
    """Query with its question mark; a bare `?` counts as none."""
    q = _part(as_col(url), 4)
    return F.when(q == "?", F.lit("")).otherwise(q)


def is_web(url: Column | str) -> Column:
    return scheme(url).isin("http", "https")


def board_form(url: Column | str) -> Column:
    """scheme://host/path, no query or fragment, no trailing slash."""
    u = as_col(url)
    return drop_trailing_slashes(F.concat(scheme(u), F.lit("://"), host(u), path(u)))


def page_form(url: Column | str) -> Column:
    """scheme://host/path?query, no fragment, no trailing slash. Null if not http(s)."""
    u = as_col(url)
    q = query(u)
    return F.when(
        is_web(u),
        drop_trailing_slashes(F.concat(scheme(u), F.lit("://"), host(u), path(u), q)),
    )


def drop_tracking(url: Column | str) -> Column:
    return F.replace(
        as_col(url), F.lit(fixed.ALERT_TRACKED_PATH), F.lit(fixed.ALERT_PATH)
    )


def is_alert_link(url: Column | str) -> Column:
    u = as_col(url)
    return u.contains(fixed.ALERT_HOST + fixed.ALERT_PATH) | u.contains(
        fixed.ALERT_HOST + fixed.ALERT_TRACKED_PATH
    )


def alert_form(url: Column | str) -> Column:
    """Everything before the first `?`, tracking segment dropped. Expects entities decoded."""
    return drop_tracking(F.split_part(as_col(url), F.lit("?"), F.lit(1)))


def ensure_protocol(url: Column | str) -> Column:
    u = strip(text(url))
    low = F.lower(u)
    return (
        F.when(u == "", u)
        .when(low.startswith("http://") | low.startswith("https://"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .otherwise(F.concat(F.lit("https://"), u))
    )


def slash_twin(url: Column | str) -> Column:
    """The other slash form: all trailing slashes off, or exactly one added."""
    u = as_col(url)
    return F.when(u.endswith("/"), drop_trailing_slashes(u)).otherwise(
        F.concat(u, F.lit("/"))
    )


def key_form(url: Column | str) -> Column:
    """One form for all under which a posting may be stored: no tracking path, no trailing slashes."""
    return drop_trailing_slashes(drop_tracking(strip(text(url))))


def match_list(url: Column | str) -> Column:
    """Array of the forms a stored key may have, best first, no repeats."""
    u = strip(text(url))
    plain = drop_tracking(u)
    tracked = F.replace(u, F.lit(fixed.ALERT_PATH), F.lit(fixed.ALERT_TRACKED_PATH))
    forms = F.concat(
        F.array(u, slash_twin(u)),
        F.when(
            u.contains(fixed.ALERT_TRACKED_PATH),
            F.array(plain, drop_trailing_slashes(plain)),
        )
        .when(u.contains(fixed.ALERT_PATH), F.array(tracked))
        .otherwise(F.array().cast("array<string>")),
    )
    return F.when(u == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(forms)
    )


def is_posting_link(
    url: Column | str,
    include: list[str] = fixed.POSTING_LINK_PATTERNS,
    exclude: list[str] = fixed.EXCLUDED_LINK_PARTS,
) -> Column:
    u = as_col(url)
    return F.coalesce(
        (F.length(u) >= fixed.MIN_LINK_CHARS)
        & ~has_any(F.lower(u), exclude)
        & matches_any(u, include),
        F.lit(False),
    )


# --- resolving ---------------------------------------------------------------------
# Written as SQL text: it is long, and parsed in one step instead of node by node.

def _sql_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, r'{_PARTS}', {group})"


def _sql_merge(base: str, href: str) -> str:
    """Relative path against a base path, `.` and `..` resolved, the href's tail kept.

    `transform` over a one-element array binds a value, so that it is computed once."""
    own = f"regexp_extract({href}, r'(?s)^([^?#]*)', 1)"
    folder = "if(element_at(s.b, -1) = '', s.b, slice(s.b, 1, size(s.b) - 1))"
    segments = f"""transform(
      array(named_struct('b', split({_sql_part(base, 3)}, '/', -1), 'o', split({own}, '/', -1))),
      s -> if(s.o[0] = '' and size(s.o) > 1, s.o, concat(
        slice({folder}, 1, 1),
        filter(concat(slice({folder}, 2, size({folder}) - 1), slice(s.o, 1, size(s.o) - 1)), x -> x <> ''),
        slice(s.o, -1, 1))))"""
    walked = """aggregate(p, cast(array() as array<string>), (done, x) -> case
        when x = '..' then slice(done, 1, greatest(size(done) - 1, 0))
        when x = '.' then done else concat(done, array(x)) end)"""
    closed = f"""array_join(concat({walked},
      if(element_at(p, -1) in ('.', '..'), array(''), cast(array() as array<string>))), '/')"""
    joined = f"transform({segments}, p -> {closed})"
    rooted = f"transform({joined}, j -> if(startswith(j, '/'), j, concat('/', j)))[0]"
    return f"concat({rooted}, substr({href}, length({own}) + 1))"


def resolve_sql(base: str, href: str) -> str:
    """SQL text for the absolute form of link `href` found on page `base`."""
    h = f"regexp_replace({href}, r'^[\x00-\x20]+|[\t\r\n]', '')"
    scheme_ = f"lower({_sql_part(base, 1)})"
    origin = f"concat({scheme_}, '://', {_sql_part(base, 2)})"
    base_path = _sql_part(base, 3)
    base_query = f"if({_sql_part(base, 4)} = '?', '', {_sql_part(base, 4)})"
    # the common forms come first and need no binding
    return f"""case when not {href} rlike r'[\x00-\x20]' and not startswith({href}, '//')
      and startswith({href}, '/') and not contains({href}, '/.') then concat({origin}, {href})
      else transform(array({h}), h -> case
      when h = '' then {base}
      when startswith(h, 'http://') or startswith(h, 'https://') then h
      when lower({_sql_part('h', 1)}) = {scheme_}
        then concat({scheme_}, substr(h, length({_sql_part('h', 1)}) + 1))
      when h rlike r'{_SCHEME}' then h
      when startswith(h, '//') then concat({scheme_}, ':', h)
      when startswith(h, '/') and not contains(h, '/.') then concat({origin}, h)
      when startswith(h, '#') then concat({origin}, {base_path}, {base_query}, h)
      when startswith(h, '?') then concat({origin}, {base_path}, h)
      else concat({origin}, {_sql_merge(base, 'h')}) end)[0] end"""


def resolve(base: str, href: str) -> Column:
    """Absolute form of the link in column `href`, found on the page in column `base`."""
    return F.expr(resolve_sql(base, href))
