"""Extraction: mail bodies, page fields, structured data, capture bodies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import fixed
from postmill.functions import urls
from postmill.functions.dom import Outline, plain_text
from postmill.functions.text import has_any, let, non_empty, squash, strip, text
from postmill.operators.dedup import dedup_first
from postmill.operators.links import alert_links, anchor_lists, anchors, block_text, resolve_links
from postmill.slices import by_slice, each
from postmill.sources.files import message_headers


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


# --- mail ------------------------------------------------------------------------

def _mail_data() -> Column:
    """The encoded html of a message: the top-level body, else the first html part with data,
    else one level deeper; null without one."""

    def html_data(parts: Column) -> Column:
        fits = F.filter(
            parts,
            lambda p: (p["mimeType"] == "text/html")
            & (F.coalesce(p["body"]["data"], F.lit("")) != ""),
        )
        return F.get(fits, F.lit(0))["body"]["data"]

    payload = F.col("payload")
    nested = F.flatten(
        F.transform(
            F.filter(payload["parts"], lambda p: p["parts"].isNotNull()),
            lambda p: p["parts"],
        )
    )
    return F.coalesce(
        F.when(payload["mimeType"] == "text/html", non_empty(payload["body"]["data"])),
        html_data(payload["parts"]),
        html_data(nested),
    )


def _mail_bytes(data: Column) -> Column:
    return F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))


def mail_errors(messages: DataFrame, keys: list[str] = ["id"]) -> DataFrame:
    """keys, error: messages whose html cannot be decoded; `mail_html` has no row for them."""
    data = messages.select(*keys, _mail_data().alias("data")).filter("data is not null")
    return data.filter(_mail_bytes(F.col("data")).isNull()).select(*keys, F.lit("not base64").alias("error"))


def mail_html(messages: DataFrame) -> DataFrame:
    """Adds `html`, see `_mail_data`; messages without one are dropped, and those that do not
    decode (see `mail_errors`). Url-safe base64; bad bytes dropped."""
    decoded = _mail_bytes(_mail_data()).cast("string")
    html = let(
        decoded,
        lambda d: F.when(F.is_valid_utf8(d), d).otherwise(
            F.replace(F.make_valid_utf8(d), F.lit("\ufffd"), F.lit(""))
        ),
    )
    # exploding drops messages without html and decodes once; a filter would decode again
    filled = F.filter(F.array(html), lambda h: h != "")
    return messages.select("*", F.explode(filled).alias("html"))


def mail_postings(messages: DataFrame, keys: list[str] = ["id"]) -> DataFrame:
    """One row per posting link of a message: keys, pos, source, url, stub text, metadata.

    The stub only says where the link came from; it is never scored."""
    read = message_headers(mail_html(messages)).select(
        *keys,
        "html",
        text(F.try_element_at("headers", F.lit("subject"))).alias("subject"),
        text(F.try_element_at("headers", F.lit("from"))).alias("sender"),
    )
    links = alert_links(read, [*keys, "subject", "sender"])
    return links.select(
        *keys,
        "pos",
        F.lit(fixed.SOURCE_MAIL).alias("source"),
        "url",
        F.concat(
            F.lit("Subject: "), "subject", F.lit("\nFrom: "), "sender",
            F.lit("\nURL: "), "url",
        ).alias("job_description"),
        F.create_map(
            F.lit("email_subject"), "subject", F.lit("email_sender"), "sender"
        ).alias("metadata"),
    )


# --- page fields -------------------------------------------------------------------

def split_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds company, role_title, location from `Company hiring Role in Place | Suffix`."""
    whole = F.col(title)
    df = df.withColumn("__t", strip(F.regexp_replace(whole, fixed.TITLE_SUFFIX_PATTERN, "")))
    at = F.instr("__t", " hiring ")
    df = df.withColumn(
        "__after", F.when(at > 0, F.substr("__t", at + len(" hiring ")))
    ).withColumn(
        "__place",
        F.when(F.col("__after").contains(" in "), F.substring_index("__after", " in ", -1)),
    )
    role = F.when(
        F.col("__place").isNotNull(),
        F.left("__after", F.length("__after") - F.length("__place") - len(" in ")),
    ).otherwise(F.col("__after"))
    return (
        df.withColumn("company", F.when(at > 0, strip(F.left("__t", at - 1))).otherwise(F.lit("")))
        .withColumn("role_title", F.when(at > 0, strip(role)).otherwise(whole))
        .withColumn("location", F.coalesce(strip("__place"), F.lit("")))
        .drop("__t", "__after", "__place")
    )


def fix_generic_titles(df: DataFrame, role: str = "role_title", heading: str = "h1") -> DataFrame:
    """A title that names no role gives way to the page heading, if there is one."""
    generic = strip(F.lower(role)).isin(fixed.GENERIC_TITLES)
    return df.withColumn(
        role,
        F.when(generic & (F.col(heading) != ""), F.col(heading)).otherwise(F.col(role)),
    )


@F.arrow_udf(T.StringType())
def _plain(values: pa.Array) -> pa.Array:
    return each(values, lambda v: None if v is None else plain_text(v), pa.string())


def to_text(df: DataFrame, col: str) -> DataFrame:
    """HTML or text -> one line of text. Only values holding a tag go to a Python worker."""
    c = text(col)
    tagged = c.contains("<") & c.contains(">")
    return df.withColumn(col, F.coalesce(_plain(F.when(tagged, c)), squash(c)))


def _opened(html: str | None, read: Callable[[Outline], dict]) -> dict:
    """What `read` makes of a page; of one that cannot be read, only `parse_error`, its kind."""
    try:
        return read(Outline(html or ""))
    except Exception as broken:  # one bad page must not end the job
        return {"parse_error": type(broken).__name__}


OUTLINE = (
    "title STRING, h1 STRING, scripts ARRAY<STRING>, main STRING, marked ARRAY<STRING>, "
    "body STRING, parse_error STRING"
)
#: Attributes that may mark the description, tried in this order.
_MARKS = {
    "class": re.compile(fixed.DESCRIPTION_CLASS_PATTERN),
    "id": re.compile(fixed.DESCRIPTION_ID_PATTERN),
    "data-testid": re.compile(fixed.DESCRIPTION_TESTID_PATTERN),
}


def page_outlines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The one Python pass over html: keys, and the texts that the columns below choose from.

    title, h1; scripts: the ld+json ones, in order; main, marked (the first container by each
    attribute, in order) and body: where a description may stand. `parse_error` names what broke
    a page, else null. Filter pages before it: nothing is pushed through. The html is dropped here."""

    def read(outline: Outline) -> dict:
        kinds = {}  # the first element of each sort, in one walk over the page
        scripts = []
        for e in outline.elements:
            kinds.setdefault(e.tag, e)
            if e.attrs.get("role") == "main":
                kinds.setdefault("[role=main]", e)
            for name, pattern in _MARKS.items():
                if name in e.attrs and name + "=" not in kinds and pattern.search(e.attrs[name]):
                    kinds[name + "="] = e
            if e.tag == "script" and e.attrs.get("type") == "application/ld+json":
                scripts.append(outline.raw(e))

        def shown(kind: str) -> str | None:
            return " ".join(outline.text(kinds[kind]).split()) if kind in kinds else None

        whole = next((k for k in ("main", "[role=main]", "article", "body") if k in kinds), "body")
        return {
            "title": outline.text(kinds["title"], "").strip() if "title" in kinds else "",
            "h1": outline.text(kinds["h1"], "") if "h1" in kinds else "",
            "scripts": scripts,
            "main": shown(whole) or "",
            "marked": [t for name in _MARKS if (t := shown(name + "=")) is not None],
            "body": "" if whole == "body" else shown("body") or "",
        }

    names = [f.split()[0] for f in OUTLINE.split(", ")]

    def job(piece: pa.RecordBatch) -> dict[str, object]:
        found = [_opened(h, read) for h in piece.column("html").to_pylist()]
        return {k: piece.column(k) for k in keys} | {n: [f.get(n) for f in found] for n in names}

    return by_slice(pages, [*keys, "html"], f"{_key_schema(pages, keys)}, {OUTLINE}", job, rows=64)


def _main_text(shortest: int) -> Column:
    """The page's main text; if it is shorter than `shortest`, a marked container's: the first
    long enough, else the last there is; if that is empty, the body's."""
    long_ones = F.filter("marked", lambda t: F.length(t) >= shortest)
    short = F.coalesce(F.get(long_ones, F.lit(0)), F.try_element_at("marked", F.lit(-1)), "main")
    found = F.when(F.length("main") >= shortest, F.col("main")).otherwise(short)
    return F.coalesce(non_empty(found), non_empty("body"), "main")  # no body where it is the main


def _items(scripts: Column | str) -> Column:
    """All objects of all ld+json scripts, in order, as variants; what is not JSON is left out."""
    parsed = F.transform(scripts, lambda t: F.try_parse_json(F.coalesce(non_empty(t), F.lit("{}"))))
    lists = F.transform(parsed, lambda v: F.coalesce(_get(v, "$", "array<variant>"), F.array(v)))
    return F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda v: v.isNotNull())


def _given(v: Column, path: str) -> Column:
    """The value at a path, null if there is none or it says nothing (null, "", 0, false, empty)."""
    return let(
        _get(v, path, "variant"),
        lambda x: F.when(
            ~F.is_variant_null(x) & ~F.to_json(x).isin('""', "0", "0.0", "false", "[]", "{}"), x
        ),
    )


def _only_text(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", _get(x, "$"))


def structured(pages: DataFrame, keys: list[str]) -> DataFrame:
    """`page_outlines` with `ld`: the first posting of its ld+json scripts that has a title or a
    description (role_title, company, location, description as given, see `to_text`), null without one.

    A title, company or place that is there but no text makes the page a parse error. A description
    that is no text is given as JSON."""
    is_posting = lambda v: (
        (_get(v, "$['@type']") == "JobPosting")
        & (_given(v, "$.title").isNotNull() | _given(v, "$.description").isNotNull())
    )
    first = F.get(F.filter(_items("scripts"), is_posting), F.lit(0))
    # bound by a generator, so that the scripts are read once
    read = page_outlines(pages, keys).select("*", F.explode(F.array(first)).alias("__ld"))
    org = _get(F.col("__ld"), "$.hiringOrganization", "map<string,variant>")
    name = F.col("__ld"), "$.hiringOrganization.name"
    parts = {
        "title": _given(F.col("__ld"), "$.title"),
        "company": _get(*name, "variant"),
        "place": _given(F.col("__ld"), "$.jobLocation.address.addressLocality"),
    }
    odd = F.lit(False)
    for part in parts.values():
        odd = odd | (part.isNotNull() & (F.schema_of_variant(part) != "STRING"))
    about = _given(F.col("__ld"), "$.description")
    read = read.withColumn(
        "__about", F.coalesce(_only_text(about), F.when(about.isNotNull(), F.to_json(about)), F.lit(""))
    )
    ld = F.struct(
        strip(text(_only_text(parts["title"]))).alias("role_title"),
        strip(text(F.when(org.isNotNull(), _only_text(parts["company"])))).alias("company"),
        strip(text(_only_text(parts["place"]))).alias("location"),
        F.col("__about").alias("description"),
    )
    broken = F.col("__ld").isNotNull() & odd
    return read.withColumns({
        "parse_error": F.when(broken, F.lit("AttributeError")).otherwise(F.col("parse_error")),
        "ld": F.when(F.col("__ld").isNotNull() & ~broken, ld),
        "__broken": broken,
    }).drop("__ld", "__about")


def jsonld_postings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that carry a structured posting: keys and its four fields."""
    marked = pages.filter(F.col("html").contains("ld+json"))
    return to_text(structured(marked, keys).filter("ld is not null").select(*keys, "ld.*"), "description")


def descriptions(
    pages: DataFrame, keys: list[str], shortest: int = fixed.MIN_DESCRIPTION_CHARS
) -> DataFrame:
    read = page_outlines(pages, keys).select(*keys, _main_text(shortest).alias("description"))
    return to_text(read, "description")


def parse_pages(
    pages: DataFrame, keys: list[str], shortest: int = fixed.MIN_DESCRIPTION_CHARS,
    chars: int | None = None,
) -> DataFrame:
    """keys, role_title, company, location, description, parse_error.

    Descriptions are whole, or the first `chars` characters if that is given."""
    read = structured(pages, keys)
    bare = F.col("ld").isNull() & F.col("parse_error").isNull()
    read = read.withColumns({
        "description": F.when(bare, _main_text(shortest)).otherwise(F.col("ld")["description"]),
        "title": F.when(bare, F.col("title")).otherwise(F.lit("")),
        "h1": F.when(bare, F.col("h1")).otherwise(F.lit("")),
    })
    titled = fix_generic_titles(split_titles(to_text(read, "description")))

    def pick(name: str) -> Column:
        return F.when(F.col("ld").isNotNull(), F.col("ld")[name]).otherwise(F.col(name))

    fields = {c: pick(c) for c in ("role_title", "company", "location")}
    fields["description"] = shortened(F.col("description"), chars)
    return titled.select(*keys, *[v.alias(c) for c, v in fields.items()], "parse_error")


def shortened(value: Column, chars: int | None) -> Column:
    return value if chars is None else F.left(value, F.lit(chars))


# --- capture bodies ------------------------------------------------------------------

POSTING_COLUMNS = ["job_url", "company", "role_title", "location", "job_description"]


_POSTINGS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in POSTING_COLUMNS]))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text_at(v: Column, name: str) -> Column:
    """A field that is text and not empty, else null."""
    return let(
        _get(v, f"$.{name}", "variant"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", non_empty(_get(x, "$"))),
    )


def _texts(v: Column, names: list[str]) -> Column:
    """First non-empty text among field aliases."""
    return F.coalesce(*[_text_at(v, n) for n in names], F.lit(""))


def _filled_object(v: Column) -> Column:
    return F.coalesce(F.size(_get(v, "$", "map<string,variant>")) > 0, F.lit(False))


def _posting_list(doc: Column | str) -> Column:
    """The posting list of a body, ARRAY<VARIANT>; null where it has none."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    data = let(
        _get(doc, "$.data", "variant"),
        lambda v: F.when(_filled_object(v), v),
    )

    def parts(d: Column) -> Column:
        first = _get(d, "$.jobPostings", "variant")
        return F.struct(
            first.alias("first"),
            _get(first, "$", "array<variant>").alias("items"),
            _get(d, "$.jobs", "array<variant>").alias("second"),
        )

    def pick(s: Column) -> Column:
        # an empty or false first list gives way to the second
        blank = (
            s["first"].isNull()
            | F.is_variant_null(s["first"])
            | s["items"].isNotNull()
            | F.to_json(s["first"]).isin("{}", '""', "0", "false")
        )
        return F.when(F.size(s["items"]) > 0, s["items"]).when(blank, s["second"])

    return let(let(F.coalesce(data, doc), parts), pick)


def _listed(o: Column) -> Column:
    """Posting fields of one object of a list."""
    company = let(
        _get(o, "$.company", "variant"),
        lambda c: F.coalesce(
            F.when(F.schema_of_variant(c) == "STRING", _get(c, "$")), _text_at(c, "name")
        ),
    )
    return F.struct(
        strip(_texts(o, fixed.LIST_URL_KEYS)).alias("job_url"),
        text(strip(company)).alias("company"),
        strip(_texts(o, fixed.LIST_TITLE_KEYS)).alias("role_title"),
        strip(_texts(o, fixed.LIST_LOCATION_KEYS)).alias("location"),
        _texts(o, fixed.LIST_DESCRIPTION_KEYS).alias("job_description"),
    )


_WALKED = frozenset((
    *fixed.WALK_URL_KEYS, *fixed.WALK_TITLE_KEYS, *fixed.WALK_COMPANY_KEYS,
    *fixed.WALK_DESCRIPTION_KEYS, *fixed.WALK_LOCATION_KEYS,
))


def _objects(body: str) -> Iterator[dict]:
    """Every object of a JSON text, parents before children, in document order."""
    open_ = [iter([json.loads(body)])]
    while open_:
        node = next(open_[-1], open_)
        if node is open_:
            open_.pop()
        elif isinstance(node, dict):
            yield node
            open_.append(iter(node.values()))
        elif isinstance(node, list):
            open_.append(iter(node))


def _brief(value: object) -> object:
    """What counts of a field's value: of an object its name or title, or that it has something else."""
    if not isinstance(value, dict):
        return value
    return {k: value[k] for k in ("name", "title") if k in value} or ({"_": 0} if value else {})


def _addressed(body: str | None) -> tuple[list[str] | None, str | None]:
    """(objects that may have an address, as JSON with the fields that count; what went wrong)."""
    if body is None:
        return None, None
    try:
        return [
            json.dumps({k: _brief(o[k]) for k in o.keys() & _WALKED})
            for o in _objects(body) if not o.keys().isdisjoint(fixed.WALK_URL_KEYS)
        ], None
    except (ValueError, RecursionError) as broken:
        return None, type(broken).__name__


def _walked(bodies: DataFrame) -> DataFrame:
    """seq, page, objects, error of bodies, see `_addressed`; slice by slice."""

    def job(piece: pa.RecordBatch) -> dict[str, object]:
        made = [_addressed(b) for b in piece.column("body").to_pylist()]
        return {k: piece.column(k) for k in ("seq", "page")} | {"objects": [o for o, _ in made], "error": [e for _, e in made]}

    schema = f"{_key_schema(bodies, ['seq', 'page'])}, objects ARRAY<STRING>, error STRING"
    return by_slice(bodies, ["seq", "page", "body"], schema, job, rows=64)


def _first_given(o: Column, names: list[str]) -> Column:
    return F.coalesce(*[_given(o, f"$.{n}") for n in names])


def _shown(x: Column) -> Column:
    """A value as text: an object by its name, or its title if it has no name; others as written."""
    named = F.coalesce(_get(x, "$.name", "variant"), _get(x, "$.title", "variant"))
    as_text = lambda v: F.coalesce(_get(v, "$"), F.to_json(v))
    return text(
        F.when(_get(x, "$", "map<string,variant>").isNotNull(), let(named, lambda v: as_text(v)))
        .otherwise(strip(as_text(x)))
    )


def _walked_posting(o: Column) -> Column:
    """Posting fields of an object met anywhere in a body."""
    fits = lambda u: u.startswith("http") & ~u.contains(fixed.AGGREGATOR_HOST)
    address = [let(_text_at(o, n), lambda u: F.when(fits(u), strip(u))) for n in fixed.WALK_URL_KEYS]
    return F.struct(
        F.coalesce(*address, F.lit("")).alias("job_url"),
        let(_first_given(o, fixed.WALK_COMPANY_KEYS), _shown).alias("company"),
        let(_first_given(o, fixed.WALK_TITLE_KEYS), _shown).alias("role_title"),
        let(_first_given(o, fixed.WALK_LOCATION_KEYS), _shown).alias("location"),
        text(let(_first_given(o, fixed.WALK_DESCRIPTION_KEYS), _only_text)).alias("job_description"),
    )


def api_postings(bodies: DataFrame) -> DataFrame:
    """Postings of captured bodies (seq, page, url, body, doc): seq, page, pos and the
    posting columns; in a body, the first of a repeated url wins.

    Bodies with a posting list are read with variant functions alone. The others pass a Python
    worker, which finds their objects in order (a variant does not keep field order); a body that
    it cannot read gives no rows, see `unread_bodies`. The two kinds are read apart: the list is
    bound by a generator, and only bodies without one are sent to Python."""
    bound = bodies.select(
        "seq", "page", "body", F.explode(F.array(F.struct(_posting_list("doc").alias("l")))).alias("b")
    )
    is_object = lambda o: _get(o, "$", "map<string,variant>").isNotNull()
    listed = bound.filter("b.l is not null").select("seq", "page", F.posexplode("b.l").alias("pos", "o"))
    listed = listed.filter(is_object(F.col("o"))).select("seq", "page", "pos", _listed(F.col("o")).alias("p"))
    walked = _walked(bound.filter("b.l is null")).select(
        "seq", "page", F.posexplode("objects").alias("pos", "o")
    ).select("seq", "page", "pos", F.explode(F.array(F.try_parse_json("o"))).alias("o"))
    walked = walked.select("seq", "page", "pos", _walked_posting(F.col("o")).alias("p"))
    rows = listed.unionByName(walked).select(
        "seq", "page", "pos", *[F.col(f"p.{c}").alias(c) for c in POSTING_COLUMNS]
    )
    kept = rows.filter(
        (F.col("job_url") != "") & ~F.col("job_url").contains(fixed.AGGREGATOR_HOST)
    )
    return dedup_first(kept, ["seq", "job_url"], ["pos"])


def unread_bodies(bodies: DataFrame) -> DataFrame:
    """seq, page, error: bodies without a posting list whose text cannot be walked."""
    rest = bodies.filter(_posting_list("doc").isNull())
    return _walked(rest).select("seq", "page", "error").filter("error is not null")


# --- rendered pages --------------------------------------------------------------------

def page_apply_links(
    pages: DataFrame, keys: list[str], shortest: int = fixed.MIN_DESCRIPTION_CHARS,
    chars: int | None = None,
) -> DataFrame:
    """Links of a rendered page into hosted application systems, with the text around them if that
    is longer than `shortest`; on pages without any, links whose text speaks of applying.

    keys (must hold `url`), pos, job_url, job_description; once per page, first wins. A page's
    links are one row, so choosing among them needs no shuffle. Texts are whole, or of `chars`
    characters. A page that cannot be parsed gives no links, an address that cannot be resolved
    none of its own."""
    lists = anchor_lists(pages, keys, context=True)
    full = urls.resolve_sql("url", "a.href")
    linked = lists.select(*keys, "spaced", F.expr(f"""filter(transform(anchors, a -> named_struct(
        'href', a.href, 'says', a.says, 'block', a.block, 'full', {full})),
        a -> a.href <> '' and a.full is not null)""").alias("links"))
    usable = lambda a: ~a["href"].startswith("#") & ~a["href"].contains("javascript:")

    def hosted(a: Column) -> Column:
        url = F.regexp_extract(a["full"], "(?i)" + fixed.HOSTED_LINK_PATTERN, 0)
        size = a["block"]["chars"] if chars is None else F.least(a["block"]["chars"], F.lit(chars))
        return F.struct(
            F.when(usable(a), url).otherwise(F.lit("")).alias("job_url"),
            F.when(size > shortest, a["block"]).alias("block"),
        )

    of_hosts = F.filter(F.transform("links", hosted), lambda p: p["job_url"] != "")
    speaking = F.transform(
        F.filter("links", lambda a: ~a["href"].contains(fixed.AGGREGATOR_HOST) & F.array_contains(a["says"], "apply")),
        lambda a: F.struct(a["full"].alias("job_url"), a["block"].alias("block")),
    )
    both = linked.select(*keys, "spaced", F.explode(F.array(F.struct(of_hosts.alias("h"), speaking.alias("s")))).alias("c"))
    chosen = both.select(*keys, "spaced", F.when(F.size("c.h") > 0, F.col("c.h")).otherwise(F.col("c.s")).alias("c"))
    chosen = chosen.select(*keys, "spaced", "c", F.transform("c", lambda p: p["job_url"]).alias("all"))
    firsts = F.filter("c", lambda p, i: F.array_position("all", p["job_url"]) == i + 1)
    rows = chosen.select(*keys, "spaced", F.posexplode(firsts).alias("pos", "p"))
    about = shortened(text(block_text(F.col("p.block"))), chars)
    return rows.select(*keys, "pos", "p.job_url", about.alias("job_description"))


def apply_buttons(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The plain variant: links whose text speaks of applying, the aggregator's own left out."""
    links = resolve_links(anchors(pages, keys))
    own, words = F.col("full").contains(fixed.AGGREGATOR_HOST), F.lower("text")
    own_posting = urls.host("full").contains(fixed.AGGREGATOR_HOST) & urls.path(
        "full"
    ).contains("/" + fixed.AGGREGATOR_POSTING_PATH)
    kept = links.filter(
        (F.col("href") != "")
        & ~F.col("href").startswith("#")
        & ~F.col("href").contains("javascript:")
        & ~(own & ~F.col("full").contains(fixed.AGGREGATOR_POSTING_PATH))
        & ~own_posting
        & has_any(words, fixed.APPLY_BUTTON_PHRASES)
    )
    return dedup_first(
        kept.select(*keys, F.col("full").alias("job_url"), "pos"), [*keys, "job_url"], ["pos"]
    )
