"""Preferences: entity names, the ordered fold of feedback, notes, reply validation.

All of it is keyed by owner, so one run serves many owners; an owner or entity with
very much feedback is reduced on the map side before anything is shuffled."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill import fixed
from postmill.functions.text import drop_controls, non_empty, strip, text, unfence
from postmill.operators.dedup import dedup_first


def canonical(entity: Column | str, aliases: dict[str, str] = fixed.ENTITY_ALIASES) -> Column:
    """Trimmed name, or the stored name of an alias (looked up in lower case)."""
    name = strip(text(entity))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)


def canonical_entities(
    df: DataFrame, col: str = "entity", aliases: dict[str, str] = fixed.ENTITY_ALIASES
) -> DataFrame:
    return df.withColumn(col, canonical(col, aliases))


def fold_preferences(events: DataFrame) -> DataFrame:
    """Standing preferences: owner, kind, value. events: (owner, seq, entity, action).

    The first action of an entity wins for good, so the fold is one `min_by`."""
    named = canonical_entities(events).filter("entity <> ''")
    return named.groupBy("owner", F.col("entity").alias("value")).agg(
        F.min_by("action", "seq").alias("kind"), F.min("seq").alias("seq")
    ).select("owner", "kind", "value", "seq")


def preference_verdicts(events: DataFrame) -> DataFrame:
    """What became of each event: owner, seq, entity, action, verdict, message.

    verdict: added, no-op, contradiction or error. The first actions (one row per
    entity) are joined to the events, so a hot entity can be split over tasks, which
    a window over its events could not."""
    every = canonical_entities(events)
    named, blank = every.filter("entity <> ''"), every.filter("entity = ''")
    first = fold_preferences(events).select(
        "owner", F.col("value").alias("entity"),
        F.col("kind").alias("first_action"), F.col("seq").alias("first_seq"),
    )
    e = F.col("entity")
    verdict = (
        F.when(e == "", F.lit("error"))
        .when(F.col("seq") == F.col("first_seq"), F.lit("added"))
        .when(F.col("action") == F.col("first_action"), F.lit("no-op"))
        .otherwise(F.lit("contradiction"))
    )
    clash = F.when(F.col("action") == "reject", F.lit(fixed.REJECT_AFTER_EXCEPTION)).otherwise(
        F.lit(fixed.EXCEPTION_AFTER_REJECT)
    )
    message = (
        F.when(e == "", F.lit(fixed.EMPTY_ENTITY_ERROR))
        .when(F.col("verdict") == "contradiction",
              F.concat(F.lit("Contradiction: "), e, F.lit(" "), clash))
    )
    # blank entities match nothing, and would all meet under one key
    bare = blank.withColumns({
        "first_action": F.lit(None).cast("string"), "first_seq": F.lit(None).cast(events.schema["seq"].dataType)
    })
    return (
        named.join(first, ["owner", "entity"], "left").unionByName(bare)
        .withColumn("verdict", verdict)
        .withColumn("message", message)
        .select("owner", "seq", "entity", "action", "verdict", "message")
    )


def stored_verdicts(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Verdicts on new events (owner, seq, entity, action), of which stored preferences came first."""
    kind = events.schema["seq"].dataType
    old = stored.filter(F.col("kind").isin("reject", "exception")).select(
        "owner", F.struct(F.lit(0).alias("era"), F.col("seq").cast(kind).alias("seq")).alias("seq"),
        F.col("value").alias("entity"), F.col("kind").alias("action"),
    )
    new = events.select(
        "owner", F.struct(F.lit(1).alias("era"), "seq").alias("seq"), "entity", "action"
    )
    judged = preference_verdicts(old.unionByName(new)).filter("seq.era = 1")
    return judged.withColumn("seq", F.col("seq.seq"))


def fold_notes(notes: DataFrame) -> DataFrame:
    """owner, value, seq: trimmed notes, blanks dropped, first mention kept."""
    trimmed = notes.select("owner", strip(text("value")).alias("value"), "seq")
    return dedup_first(trimmed.filter("value <> ''"), ["owner", "value"], ["seq"])


def merge_preferences(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored preferences folded with new feedback; what is stored came first."""
    old = stored.filter(F.col("kind") != "note").select(
        "owner", F.col("value").alias("entity"), F.col("kind").alias("action"),
        F.struct(F.lit(0).alias("era"), "seq").alias("seq"),
    )
    new = events.select("owner", "entity", "action", F.struct(F.lit(1).alias("era"), "seq").alias("seq"))
    folded = fold_preferences(old.unionByName(new)).withColumn("seq", F.col("seq.seq"))
    return folded.unionByName(stored.filter("kind = 'note'").select(*folded.columns))


PROMPT_CAPS = {
    "reject": fixed.MAX_REJECTS, "exception": fixed.MAX_EXCEPTIONS, "note": fixed.MAX_NOTES
}


def preference_block(prefs: DataFrame, caps: dict[str, int] = PROMPT_CAPS) -> DataFrame:
    """owner, block: the lists as a text for a prompt. prefs: (owner, kind, value, seq).

    Rejects and exceptions are taken in name order, notes in seq order, each up to its cap in
    `caps`, which is what bounds the text. It is applied before collecting."""
    longest = max(caps.values())
    rank_by = F.when(F.col("kind") == "note", F.lit("")).otherwise(F.col("value"))
    place = F.row_number().over(W.partitionBy("owner", "kind").orderBy(rank_by, "seq"))
    kept = (
        prefs.filter(F.col("kind").isin(*caps))
        .withColumn("place", place)
        .filter(F.col("place") <= longest)  # limit known to the planner: cut on the map side
    )
    room = F.lit(None)
    for kind, cap in caps.items():
        room = F.when(F.col("kind") == kind, F.lit(cap)).otherwise(room)
    kept = kept.filter(F.col("place") <= room)

    def listed(kind: str) -> Column:
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "value")))
        return F.transform(F.array_sort(entries), lambda x: x["value"]).alias(kind)

    lists = kept.groupBy("owner").agg(*[listed(k) for k in caps])

    def line(label: str, kind: str) -> Column:
        return F.when(
            F.size(kind) > 0, F.concat(F.lit(label), F.array_join(kind, ", "))
        )

    notes = F.array_join(F.transform("note", lambda n: F.concat(F.lit("- "), n)), "\n")
    body = F.concat_ws(
        "\n",
        line(fixed.PREFS_REJECT_LABEL, "reject"),
        line(fixed.PREFS_EXCEPTION_LABEL, "exception"),
        non_empty(notes),
    )
    return lists.select(
        "owner",
        F.when(body != "", F.concat(F.lit(fixed.PREFS_HEADING), body, F.lit("\n\n")))
        .otherwise(F.lit("")).alias("block"),
    )


def parse_feedback_replies(replies: DataFrame) -> DataFrame:
    """Adds entity and action to feedback replies (…, reply); both null where invalid.

    The caller keeps the rows with a null entity as the dead letters to ask about."""
    doc = F.try_parse_json(drop_controls(unfence("reply")))

    def said(name: str) -> Column:
        v = F.try_variant_get("__doc", f"$.{name}", "variant")
        is_text = F.schema_of_variant(v) == "STRING"
        return F.when(is_text, strip(F.try_variant_get("__doc", f"$.{name}", "string")))

    df = replies.withColumn("__doc", doc).withColumn("__e", said("entity")).withColumn(
        "__a", F.lower(said("action"))
    )
    good = (F.col("__e") != "") & F.col("__a").isin("reject", "exception")
    return df.withColumn("entity", F.when(good, F.col("__e"))).withColumn(
        "action", F.when(good, F.col("__a"))
    ).drop("__doc", "__e", "__a")


def feedback_status(replies: DataFrame, tries: int | None = None) -> DataFrame:
    """One row per feedback line (owner, seq): its first valid reply, of the first `tries` if given.

    replies: (owner, seq, try, reply). status: parsed or PARSE_FAILED."""
    parsed = parse_feedback_replies(replies)
    if tries is not None:
        parsed = parsed.filter(F.col("try") < tries)
    return parsed.groupBy("owner", "seq").agg(
        F.min_by(
            F.struct("entity", "action"),
            F.when(F.col("entity").isNotNull(), F.col("try")),
        ).alias("p")
    ).select(
        "owner", "seq", "p.entity", "p.action",
        F.when(F.col("p.entity").isNotNull(), F.lit("parsed"))
        .otherwise(F.lit("PARSE_FAILED")).alias("status"),
    )
