"""Links: anchors out of pages, resolving, canonical forms, classification."""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import fixed
from postmill.functions import urls
from postmill.functions.dom import Element, Outline
from postmill.functions.text import matches_any, strip, text
from postmill.slices import by_slice, each

# comments and scripts may hold markup that is not a link
_NOT_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_HREF = r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ALERT_HREF = r"""(?i)href=["']([^\n]*?)["']"""


_PLACE_BITS = 24


def arrival(page_seq: Column | str, pos: Column | str) -> Column:
    """One sortable BIGINT for (page, place on page): up to 2^24 places a page, pages up to 2^39.

    Beyond either, order would silently be lost: that is an error."""
    page = (F.col(page_seq) if isinstance(page_seq, str) else page_seq).cast("bigint")
    place = (F.col(pos) if isinstance(pos, str) else pos).cast("bigint")
    over = (F.abs(page) >= 1 << (63 - _PLACE_BITS)) | (place >= 1 << _PLACE_BITS)
    return F.when(
        over, F.raise_error(F.lit("page or place too large to order arrivals by")).cast("bigint")
    ).otherwise(F.shiftleft(page, _PLACE_BITS) + place)


def _decode(c: Column) -> Column:
    for entity, char in (
        ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
        ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def hrefs(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Anchor targets in document order: keys, pos, href. Built-in expressions only.

    Decodes the XML entities; `anchors` decodes all of them and adds the text."""
    markup = F.regexp_replace("html", _NOT_MARKUP, " ")
    found = F.regexp_extract_all(markup, F.lit(_HREF), F.lit(1))
    return pages.select(*keys, F.posexplode(found).alias("pos", "href")).select(
        *keys, "pos", strip(_decode(F.regexp_replace("href", "^[\"']|[\"']$", ""))).alias("href")
    )


#: What the text of an anchor may speak of: phrases in it, or all of it (in lower case).
SPEAKS_OF = {
    "roles": (fixed.OPEN_ROLES_PHRASES, []),
    "careers": (fixed.CAREERS_PHRASES, fixed.CAREERS_EXACT_TEXTS),
    "apply": (fixed.APPLY_PHRASES, []),
}
ANCHOR = ("STRUCT<pos: INT, href: STRING, first: INT, size: INT, says: ARRAY<STRING>, "
          "block: STRUCT<first: INT, size: INT, chars: INT>>")


class _Shown:
    """The shown text of a page once, and where each of its pieces is in it."""

    def __init__(self, outline: Outline):
        texts = ["" if hidden else t.strip() for t, hidden in outline.pieces]
        raw = [t.encode() for t in texts]
        self.glued, self.spaced = b"".join(raw), b" ".join(r for r in raw if r)
        lowered = [t.lower() for t in texts]
        self.lowered = "".join(lowered)
        # bytes, characters and lower-case characters before each piece; bytes and characters with spaces
        self.bytes, self.low = self._before(map(len, raw)), self._before(map(len, lowered))
        self.bytes_spaced = self._before(len(r) + 1 if r else 0 for r in raw)
        self.chars_spaced = self._before(len(t) + 1 if t else 0 for t in texts)
        self.hits = {name: self._hits(phrases) for name, (phrases, _) in SPEAKS_OF.items()}

    @staticmethod
    def _before(sizes) -> list[int]:
        return [0, *accumulate(sizes)]

    def _hits(self, phrases: list[str]) -> tuple[list[int], list[int]]:
        """Starts of phrases in order, and for each the least end of those that start there or later."""
        found = sorted((m.start(), m.start() + len(p)) for p in phrases for m in re.finditer(f"(?={re.escape(p)})", self.lowered))
        ends = list(accumulate((e for _, e in reversed(found)), min))
        return [b for b, _ in found], ends[::-1]

    def says(self, first: int, last: int) -> list[str]:
        low, high = self.low[first], self.low[last]
        out = []
        for name, (starts, ends) in self.hits.items():
            at = bisect_left(starts, low)
            exact = SPEAKS_OF[name][1]
            if (at < len(ends) and ends[at] <= high) or (
                exact and high - low <= max(map(len, exact)) and self.lowered[low:high] in exact
            ):
                out.append(name)
        return out

    def anchor(self, element: Element) -> dict:
        first, last = element.first, len(self.bytes) - 1 if element.last is None else element.last
        begin = self.bytes[first]
        return {"first": begin, "size": self.bytes[last] - begin, "says": self.says(first, last)}

    def block(self, element: Element) -> dict:
        first, last = element.first, len(self.bytes) - 1 if element.last is None else element.last
        begin, size = self.bytes_spaced[first], self.bytes_spaced[last] - self.bytes_spaced[first]
        chars = self.chars_spaced[last] - self.chars_spaced[first]
        return {"first": begin, "size": max(0, size - 1), "chars": max(0, chars - 1)}


def anchor_lists(pages: DataFrame, keys: list[str], context: bool = False) -> DataFrame:
    """One row per page: keys, `anchors`, every `<a href>` in document order, and the page's shown text.

    An anchor has no text of its own but its place in `glued` (see `anchor_text`), and what SPEAKS_OF
    that is in it; with `context`, also the place of its nearest enclosing block in `spaced` (see
    `block_text`). So a row grows with the page, however deep unclosed anchors nest and however many
    links share a block. A page that cannot be parsed has no anchors and the kind of its error in
    `error`, else null. Filter pages first: nothing is pushed through this job. It keeps a page's links
    in its row, so that per-page work after it is array functions and needs no shuffle."""
    names = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    blocks = frozenset(fixed.CONTEXT_TAGS)

    def page_anchors(html: str | None) -> tuple:
        try:
            return *read(html), None
        except Exception as broken:  # one bad page must not end the job
            return [], b"", b"", type(broken).__name__

    def read(html: str | None) -> tuple[list[dict], bytes, bytes]:
        outline = Outline(html or "")
        links = [e for e in outline.elements if e.tag == "a" and "href" in e.attrs]
        shown, around = _Shown(outline), {}
        if context:  # elements come parents first
            for e in outline.elements:
                above = None if e.parent is None else around[id(e.parent)]
                around[id(e)] = e if e.tag in blocks else above

        def block(a: Element) -> dict | None:
            found = None if not context or a.parent is None else around[id(a.parent)]
            return None if found is None else shown.block(found)

        made = [
            {"pos": pos, "href": a.attrs["href"].strip(), **shown.anchor(a), "block": block(a)}
            for pos, a in enumerate(links)
        ]
        return made, shown.glued, shown.spaced if context else b""

    def job(piece: pa.RecordBatch) -> dict[str, object]:
        made = zip(*map(page_anchors, piece.column("html").to_pylist()), strict=True)
        return {k: piece.column(k) for k in keys} | dict(zip(("anchors", "glued", "spaced", "error"), map(list, made), strict=True))

    schema = f"{names}, anchors ARRAY<{ANCHOR}>, glued BINARY, spaced BINARY, error STRING"
    return by_slice(pages, [*keys, "html"], schema, job, rows=64)


def _slice(text: Column | str, first: Column, size: Column) -> Column:
    return F.substring(text, first + 1, size).cast("string")


def anchor_text(anchor: Column, glued: Column | str = "glued") -> Column:
    """The text of an anchor: a slice of its page's text."""
    return _slice(glued, anchor["first"], anchor["size"])


def block_text(block: Column, spaced: Column | str = "spaced") -> Column:
    """The text of the block around an anchor (null without one): a slice of its page's text."""
    return _slice(spaced, block["first"], block["size"])


def anchors(pages: DataFrame, keys: list[str], context: bool = False) -> DataFrame:
    """One row per `<a href>`: keys, pos, href, text (and context). Texts are cut out row by row."""
    a = F.col("a")
    rows = anchor_lists(pages, keys, context).select(*keys, "glued", "spaced", F.explode("anchors").alias("a"))
    about = [block_text(a["block"]).alias("context")] if context else []
    return rows.select(*keys, "a.pos", "a.href", anchor_text(a).alias("text"), *about)


def is_followable(href: Column | str) -> Column:
    """Not empty, not a fragment of the page itself, not a script."""
    h = F.col(href) if isinstance(href, str) else href
    return (h != "") & ~h.startswith("#") & ~h.startswith("javascript:")


def followable(links: DataFrame) -> DataFrame:
    return links.filter(is_followable("href"))


def resolve_links(links: DataFrame, base: str = "url") -> DataFrame:
    """Adds `full`: the link made absolute against its page."""
    return links.withColumn("full", urls.resolve(base, "href"))


def canonical_page_links(links: DataFrame) -> DataFrame:
    """Replaces `full` by `link`: http(s) only, no fragment, query kept."""
    # exploding drops the others with one evaluation; a null filter would resolve twice
    web = F.array_compact(F.array(urls.page_form("full")))
    return links.select(
        *[c for c in links.columns if c != "full"], F.explode(web).alias("link")
    )


def canonical_board_links(links: DataFrame) -> DataFrame:
    """Replaces `full` by `link`: no query or fragment, no trailing slash."""
    return links.withColumn("link", urls.board_form("full")).drop("full")


def ensure_protocol(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, urls.ensure_protocol(col))


def classify_links(
    links: DataFrame,
    col: str = "link",
    include: list[str] = fixed.POSTING_LINK_PATTERNS,
    exclude: list[str] = fixed.EXCLUDED_LINK_PARTS,
) -> DataFrame:
    """Adds `is_posting`."""
    return links.withColumn("is_posting", urls.is_posting_link(col, include, exclude))


def board_slugs(links: DataFrame, col: str = "full") -> DataFrame:
    """Links to a known board: adds slug (lower case) and posting_no. A search, not a full match."""
    pattern = "(?i)" + fixed.BOARD_LINK_PATTERN
    return (
        links.filter(F.col(col).rlike(pattern))
        .withColumn("slug", F.lower(F.regexp_extract(col, pattern, 1)))
        .withColumn("posting_no", F.regexp_extract(col, pattern, 2))
    )


def hosted_links(links: DataFrame, col: str = "full") -> DataFrame:
    """Links into a hosted application system: adds `apply_url`, the matched text."""
    pattern = "(?i)" + fixed.HOSTED_LINK_PATTERN
    return links.withColumn("apply_url", F.regexp_extract(col, pattern, 0)).filter(
        "apply_url <> ''"
    )


def match_variants(df: DataFrame, col: str = "url") -> DataFrame:
    """One row per form a stored key may have: adds prio (0 first) and variant."""
    return df.select("*", F.posexplode(urls.match_list(col)).alias("prio", "variant"))


# --- alert links ---------------------------------------------------------------

@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape(lists: pa.Array) -> pa.Array:
    return each(lists, lambda hrefs: hrefs and [_html.unescape(h) for h in hrefs], pa.list_(pa.string()), rows=512)


def canonical_alert_urls(df: DataFrame, col: str = "href") -> DataFrame:
    """Known posting paths only, in canonical form, as `url`. Decodes all HTML entities."""
    decoded = _unescape(F.array(text(col)))[0]
    return (
        df.withColumn("url", decoded)
        .filter(urls.is_alert_link("url"))
        .withColumn("url", urls.alert_form("url"))
    )


def alert_links(messages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Canonical posting links of each message, first mention first, once each: keys, pos, url.

    All of a message's links sit in one row, so its dedup is an array function, not a shuffle."""
    # a link can only become a posting link if it names the path, or hides it in entities
    candidate = lambda h: h.contains(fixed.ALERT_PATH) | h.contains("&")
    raw = messages.select(
        *keys,
        F.filter(
            F.regexp_extract_all(html, F.lit(_ALERT_HREF), F.lit(1)), candidate
        ).alias("hrefs"),
    )
    found = F.array_distinct(
        F.transform(F.filter(_unescape("hrefs"), urls.is_alert_link), urls.alert_form)
    )
    return raw.select(*keys, F.posexplode(found).alias("pos", "url"))


# --- choosing among the links of one page (array functions, no shuffle) ---------
# These work on `anchors` as `resolve_lists` leaves it: each anchor has its `full` address.

def resolve_lists(lists: DataFrame, base: str = "url") -> DataFrame:
    """Adds `full` to every anchor of every page."""
    full = urls.resolve_sql(base, "a.href")
    return lists.withColumn(
        "anchors",
        F.expr(f"""transform(anchors, a -> named_struct(
            'pos', a.pos, 'href', a.href, 'says', a.says, 'full', {full}))"""),
    )


def posting_list(anchor_list: Column | str) -> Column:
    """Canonical posting links of a page, first mention first, once each."""
    links = F.transform(
        F.filter(anchor_list, lambda a: is_followable(a["href"])),
        lambda a: urls.page_form(a["full"]),
    )
    return F.array_distinct(F.filter(links, lambda u: urls.is_posting_link(u)))


def open_roles_anchor(anchor_list: Column | str) -> Column:
    """The first http(s) anchor whose text speaks of open roles; null if none."""
    fits = lambda a: (
        is_followable(a["href"])
        & F.array_contains(a["says"], "roles")
        & urls.is_web(a["full"])
    )
    return F.get(F.filter(anchor_list, fits), F.lit(0))


def careers_anchor(anchor_list: Column | str) -> Column:
    """The first http(s) anchor whose path or text points to careers; null if none."""
    fits = lambda a: (
        (a["href"] != "")
        & ~a["href"].startswith("#")
        & urls.is_web(a["full"])
        & (
            matches_any(F.lower(urls.path(a["full"])), fixed.CAREERS_PATH_PATTERNS)
            | F.array_contains(a["says"], "careers")
        )
    )
    return F.get(F.filter(anchor_list, fits), F.lit(0))


def open_roles_link(lists: DataFrame) -> DataFrame:
    return lists.withColumn("open_roles_url", open_roles_anchor("anchors")["full"])


def careers_link(lists: DataFrame) -> DataFrame:
    return lists.withColumn("careers_url", careers_anchor("anchors")["full"])
