"""Scoring as data: closed roles, packs, replies of a user's function, rules, digest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import (
    drop_controls, has_any, non_empty, text, unfence,
)
from postmill.operators.prefs import canonical
from postmill.operators.sequence import dense_index, pack_no
from postmill.session import settle

# --- closed roles ------------------------------------------------------------------

def is_closed(phrases: list[str] = fixed.CLOSED_PHRASES) -> Column:
    words = F.lower(F.concat(text("job_description"), F.lit(" "), text("location_text")))
    return has_any(words, phrases)


def split_closed(
    df: DataFrame, phrases: list[str] = fixed.CLOSED_PHRASES
) -> tuple[DataFrame, DataFrame]:
    """(closed, open): closed roles get a fixed reject, open ones go on to scoring."""
    closed = is_closed(phrases)
    rejected = df.filter(closed).select(
        "seq",
        "url",
        F.lit("reject").alias("bucket"),
        F.array(F.lit(fixed.CLOSED_REASON)).alias("why"),
        F.lit(fixed.NEXT_SKIP).alias("what_to_do_next"),
    )
    return rejected, df.filter(~closed)


# --- packs ----------------------------------------------------------------------------

def pack(df: DataFrame, size: int = fixed.PACK_SIZE, chars: int | None = None) -> DataFrame:
    """Adds `batch` (0, 1, 2…) and `place` (1..size): packs of exactly `size` in seq order.

    Descriptions stay whole, or are cut to `chars` characters where a model takes no more."""
    whole = text("job_description")
    cut = whole if chars is None else F.left(whole, F.lit(chars))
    trimmed = df.withColumn("job_description", cut) if "job_description" in df.columns else df
    return (
        dense_index(trimmed, "seq")
        .withColumn("batch", pack_no(F.col("idx"), size))
        .withColumn("place", (F.col("idx") - F.col("batch") * size).cast("int"))
        .drop("idx")
    )


def _card(place: Column) -> Column:
    """One posting as labelled text."""
    named = lambda c: F.coalesce(non_empty(text(c)), F.lit("(none)"))
    about = text("job_description")
    return F.concat(
        F.lit("Job "), place.cast("string"), F.lit(":\nURL: "), text("url"),
        F.lit("\nTitle: "), named("title"),
        F.lit("\nCompany: "), named("company"),
        F.lit("\nLocation: "), named("location_text"),
        F.when(about != "", F.concat(F.lit("\nJob Description:\n"), about)).otherwise(
            F.lit("\nJob Description: (empty)")
        ),
    )


def render_batches(packed: DataFrame) -> DataFrame:
    """batch, n, batch_text. A pack has at most its fixed size of rows."""
    cards = F.array_sort(F.collect_list(F.struct("place", _card(F.col("place")).alias("card"))))
    return packed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(cards, lambda c: c["card"]), fixed.PACK_SEPARATOR).alias(
            "batch_text"
        ),
    )


def with_prompts(packed: DataFrame, preferences: str = "") -> DataFrame:
    """Adds what a model is told: `batch_text`, in the first row of a pack, and `preferences`."""
    texts = render_batches(packed).select("batch", "batch_text")
    return packed.join(texts, "batch").withColumns({
        "batch_text": F.when(F.col("place") == 1, F.col("batch_text")),
        "preferences": F.lit(preferences),
    })


# --- replies ---------------------------------------------------------------------------

_LISTS = ["true_matches", "monitor", "rejects"]


def _kind(v: Column, path: str) -> Column:
    """Type of a JSON field: null where the field is missing, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path) == "STRING", F.lit(False))


def _texts_only(v: Column, path: str) -> Column:
    items = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.forall(items, lambda i: _is_text(i, "$")), F.lit(False))


def _items_valid(doc: Column, name: str) -> Column:
    """A list may be missing; if it is there, every item must have all four fields, typed."""
    items = F.try_variant_get(doc, f"$.{name}", "array<variant>")
    good = F.forall(
        items,
        lambda i: _is_text(i, "$.url") & _is_text(i, "$.bucket")
        & _is_text(i, "$.what_to_do_next") & _texts_only(i, "$.why"),
    )
    return _kind(doc, f"$.{name}").isNull() | F.coalesce(good, F.lit(False))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Adds `valid`, `items` ARRAY<STRUCT<list, pos, url, bucket, why, what_to_do_next>> and
    `notes` ARRAY<STRING> to replies (…, text). Validation is strict: wrong type or missing
    field anywhere makes the whole reply invalid; a single note becomes a list."""
    whole = unfence("text")
    body = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    cleaned = drop_controls(F.when(body != "", body).otherwise(whole))
    df = replies.withColumn("__doc", F.try_parse_json(cleaned))
    doc = F.col("__doc")
    notes_kind = _kind(doc, "$.notes")
    notes_ok = notes_kind.isNull() | (notes_kind == "STRING") | _texts_only(doc, "$.notes")
    valid = F.schema_of_variant(doc).startswith("OBJECT") & notes_ok
    for name in _LISTS:
        valid = valid & _items_valid(doc, name)

    def items(rank: int, name: str) -> Column:
        return F.transform(
            F.try_variant_get(doc, f"$.{name}", "array<variant>"),
            lambda i, pos: F.struct(
                F.lit(rank).alias("list"),
                pos.alias("pos"),
                F.try_variant_get(i, "$.url", "string").alias("url"),
                F.try_variant_get(i, "$.bucket", "string").alias("bucket"),
                F.try_variant_get(i, "$.why", "array<string>").alias("why"),
                F.try_variant_get(i, "$.what_to_do_next", "string").alias("what_to_do_next"),
            ),
        )

    kind = ("array<struct<list:int,pos:int,url:string,bucket:string,why:array<string>,"
            "what_to_do_next:string>>")
    none = F.array().cast(kind)
    lists = F.concat(*[F.coalesce(items(r, n).cast(kind), none) for r, n in enumerate(_LISTS)])
    no_notes = F.array().cast("array<string>")
    notes = F.coalesce(
        F.when(notes_kind == "STRING", F.array(F.try_variant_get(doc, "$.notes", "string"))),
        F.try_variant_get(doc, "$.notes", "array<string>"),
        no_notes,
    )
    ok = F.col("valid")
    return (
        df.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("items", F.when(ok, lists).otherwise(none))
        .withColumn("notes", F.when(ok, notes).otherwise(no_notes))
        .drop("__doc")
    )


ScoreFn = Callable[[pd.DataFrame, int], str]


def ask(packed: DataFrame, fn: ScoreFn, attempt: int) -> DataFrame:
    """batch, try, text: the user's function on every pack. Replies are checkpointed,
    so that a lost executor does not have them asked, and paid for, again."""

    def one(pack: pd.DataFrame) -> pd.DataFrame:
        reply = fn(pack.sort_values("place", ignore_index=True), attempt)
        return pd.DataFrame({"batch": pack["batch"].iloc[:1], "try": attempt, "text": reply})

    return settle(
        packed.groupBy("batch").applyInPandas(one, "batch BIGINT, try INT, text STRING")
    )


def score(packed: DataFrame, fn: ScoreFn) -> DataFrame:
    """Parsed replies, one per pack: batch, try, valid, items, notes. A pack whose reply
    is invalid is asked once more; the second reply stands, valid or not."""
    first = parse_replies(ask(packed, fn, 0))
    again = packed.join(first.filter("not valid").select("batch"), "batch", "left_semi")
    second = parse_replies(ask(again, fn, 1))
    return first.filter("valid").unionByName(second).drop("text")


def assemble(closed: DataFrame, packed: DataFrame, parsed: DataFrame) -> DataFrame:
    """All scores of a run in list order: ord, url, bucket, why, what_to_do_next.

    `ord` sorts by list (true_match, monitor, reject), closed roles before scored ones,
    then pack and place. A failed pack becomes one reject per row, to review by hand. The
    bucket is the item's own field, whatever list it sits in."""

    def placed(rank, part, batch, pos) -> Column:
        return F.struct(
            F.lit(rank).cast("int").alias("list") if isinstance(rank, int) else rank.alias("list"),
            F.lit(part).alias("part"),
            batch.cast("bigint").alias("batch"),
            pos.cast("bigint").alias("pos"),
        ).alias("ord")

    columns = ["ord", "url", "bucket", "why", "what_to_do_next"]
    automatic = closed.withColumn(
        "ord", placed(2, 0, F.lit(0), F.col("seq"))
    ).select(columns)
    given = parsed.select("batch", F.inline("items")).withColumn(
        "ord", placed(F.col("list"), 1, F.col("batch"), F.col("pos"))
    ).select(columns)
    failed = (
        packed.join(parsed.filter("not valid").select("batch"), "batch", "left_semi")
        .select(
            placed(2, 1, F.col("batch"), F.col("place")),
            "url",
            F.lit("reject").alias("bucket"),
            F.array(F.lit(fixed.FAILED_REASON)).alias("why"),
            F.lit(fixed.NEXT_REVIEW).alias("what_to_do_next"),
        )
    )
    return automatic.unionByName(given).unionByName(failed)


def digest_notes(parsed: DataFrame) -> DataFrame:
    """batch, pos, note: the notes of all packs in order."""
    failed = F.array(F.lit(fixed.FAILED_NOTE))
    return parsed.select(
        "batch", F.posexplode(F.when(F.col("valid"), F.col("notes")).otherwise(failed))
        .alias("pos", "note")
    )


# --- rules -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """Fires where all of `all_of` and, if any are named, one of `any_of` occur."""

    name: str
    bucket: str
    all_of: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    overridable: bool = False  # an entity exception lifts it

    def fires(self, words: Column) -> Column:
        hit = F.lit(True)
        for term in self.all_of:
            hit = hit & words.contains(term)
        return hit & has_any(words, self.any_of) if self.any_of else hit


DEFAULT_BUCKET = "monitor"
_BLANKS = "[ \\t\\n\\r\\f\\x0B]+"
#: Characters of the piece of a word through which a pattern is looked for.
_GRAM = 3


def _parts(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(c, _BLANKS), lambda w: w != ""))


def _grams(word: Column, size: int = _GRAM) -> Column:
    """The word's pieces of `size` characters; a shorter word is one."""
    last = F.greatest(F.length(word) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(size))))


def first_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """seq, pattern: for each of rows (seq, words in lower case) that holds some of patterns (seq, pattern)
    anywhere in its words, in any case, the first of these.

    Patterns are a table of any size: no expression is made for one. A pattern's words, but for the ends
    of its first and last, are words of the text, so each piece of them is in a word of the text. A
    pattern is looked for through its rarest piece, by its places in words of all rows: by it, it meets the words
    that hold the piece and its own word, by these the rows, and only there the whole is compared. Words
    shorter than a piece are met whole or by what they begin. Blank patterns are none."""
    listed = patterns.select(F.col("seq").alias("ord"), F.col("pattern").alias("shown"), F.lower(text("pattern")).alias("p"))
    listed = listed.groupBy("p").agg(F.min(F.struct("ord", "shown")).alias("first")).select("p", "first.*")
    tokens = rows.select("seq", F.explode(_parts("words")).alias("token"))
    vocabulary = settle(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    wanted = settle(listed.select("p", "ord", "shown", F.explode(_parts("p")).alias("part")))
    short = F.length("part") < _GRAM
    pieces = wanted.select("p", "ord", "shown", "part", short.alias("short"), F.explode(_grams(F.col("part"))).alias("gram"))

    def holding(grams: DataFrame) -> DataFrame:
        """Words that hold some of `grams`, once for each place: pieces are met as they are cut, none is moved or kept."""
        at, size = F.col("at"), F.length("token")
        placed = vocabulary.select("token", "n", F.explode(F.sequence(F.lit(1), F.greatest(size - _GRAM + 1, F.lit(1)))).alias("at"))
        held = placed.select("token", "n", F.substring("token", at, F.lit(_GRAM)).alias("gram"))
        # a short part may begin or end anywhere in a word: of words all its places count
        placed = vocabulary.select("token", "n", F.explode(F.sequence(F.lit(1), size)).alias("at"))
        brief = placed.select("token", "n", F.explode(F.array(
            *[F.substring("token", at, F.lit(k)) for k in range(1, _GRAM)]
        )).alias("gram"))
        return held.join(grams, "gram").unionByName(brief.join(grams.filter("short"), "gram"))

    counts = holding(pieces.select("gram", "short").distinct()).groupBy("gram").agg(F.sum("n").alias("n"))
    rated = pieces.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rated.groupBy("p").agg(F.min(F.struct("n", "short", "gram", "part")).alias("b"), F.first("ord").alias("ord"), F.first("shown").alias("shown"))
    best = settle(best.select("p", "ord", "shown", "b.gram", "b.part", "b.short"))
    holds = holding(best).filter(F.col("token").contains(F.col("part")))
    holds = settle(holds.select("token", "p", "ord", "shown").distinct())
    found = tokens.join(holds, "token").select("seq", "p", "ord", "shown").distinct()
    checked = rows.join(found, "seq").filter(F.col("words").contains(F.col("p")))
    return checked.groupBy("seq").agg(F.min(F.struct("ord", "shown")).alias("m")).select("seq", F.col("m.shown").alias("pattern"))


def bucket_by_rules(
    df: DataFrame,
    rules: list[Rule],
    prefs: DataFrame | None = None,
    patterns: list[str] | DataFrame | None = None,
    phrases: list[str] = fixed.CLOSED_PHRASES,
    default: str = DEFAULT_BUCKET,
) -> DataFrame:
    """Deterministic scoring: adds bucket and why.

    Precedence: closed, learned pattern, entity reject, category reject (unless the
    entity is an exception and the rule can be overridden), positive rule, default.
    The rules are few and become one expression; preferences (kind, value) are joined
    on the canonical entity, one row per entity. Patterns are a short list, tested in turn, or a
    table (seq, pattern) of any size, see `first_patterns`."""
    # bound once, so the text is lower-cased a single time per row
    df = df.withColumn(
        "__words",
        F.lower(F.concat_ws(" ", text("title"), text("job_description"), text("location_text"))),
    )
    words = F.col("__words")
    if isinstance(patterns, DataFrame):
        hits = first_patterns(df.select("seq", F.col("__words").alias("words")), patterns)
        df = df.join(settle(hits).withColumnRenamed("pattern", "__pattern"), "seq", "left")
    else:
        tested = None
        for p in patterns or []:
            hit = words.contains(p.lower())
            tested = F.when(hit, F.lit(p)) if tested is None else tested.when(hit, F.lit(p))
        df = df.withColumn("__pattern", F.lit(None).cast("string") if tested is None else tested)
    learned = F.col("__pattern")
    if prefs is None:
        df = df.withColumn("__kind", F.lit(None).cast("string"))
    else:
        kinds = prefs.filter(F.col("kind").isin("reject", "exception")).groupBy("value").agg(
            F.min("kind").alias("__kind")  # an exception stands before a reject
        )
        df = df.withColumn("__entity", canonical("company")).join(
            kinds.withColumnRenamed("value", "__entity"), "__entity", "left"
        ).drop("__entity")
    kind = F.col("__kind")
    excepted = F.coalesce(kind == "exception", F.lit(False))
    steps: list[tuple[Column, str, Column | str]] = [
        (is_closed(phrases), "reject", fixed.CLOSED_REASON),
        (learned.isNotNull(), "reject", F.concat(F.lit("pattern: "), learned)),
    ]
    steps.append((F.coalesce(kind == "reject", F.lit(False)), "reject", "entity: reject"))
    for r in sorted(rules, key=lambda r: r.bucket != "reject"):
        lifted = excepted if r.overridable and r.bucket == "reject" else F.lit(False)
        steps.append((r.fires(words) & ~lifted, r.bucket, f"rule: {r.name}"))
    verdict = None
    for test, bucket, why in steps:
        value = F.struct(F.lit(bucket).alias("bucket"), F.array(why if isinstance(why, Column) else F.lit(why)).alias("why"))
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    verdict = verdict.otherwise(
        F.struct(F.lit(default).alias("bucket"), F.array(F.lit("no rule fired")).alias("why"))
    )
    return (
        df.withColumn("__v", verdict)
        .withColumns({"bucket": F.col("__v.bucket"), "why": F.col("__v.why")})
        .drop("__v", "__words", "__kind", "__pattern")
    )
