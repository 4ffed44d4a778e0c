from __future__ import annotations

from pyspark.sql import functions as F

from postmill.bindings.base import load, query
from postmill.operators import scoring as S
from postmill.operators.lifecycle import summary
from postmill.operators.reports import bucket_counts as count_buckets
from postmill.operators.reports import bucket_digest as list_buckets
from postmill.operators.upsert import render_reasons


def postings(spark, sf):
    """Every document as a posting to score."""
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://d.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
        .otherwise("").alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location_text"),
        F.col("text").alias("job_description"),
    )


_PACKED = """d AS (SELECT doc_id AS seq, 'https://d.example.com/' || doc_id AS url,
    CASE WHEN lang = 'en' THEN 'Doc ' || doc_id ELSE '' END AS title, source AS company,
    lang AS location_text, text AS about,
    row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
p AS (SELECT *, i // 10 AS batch, i % 10 + 1 AS place FROM d)"""


@query(f"WITH {_PACKED} SELECT seq, batch, place, length(about) AS chars FROM p", ints="place chars")
def doc_packs(spark, sf):
    return S.pack(postings(spark, sf)).select(
        "seq", "batch", "place", F.length("job_description").alias("chars")
    )


_TEXT = """string_agg('Job ' || place || ':' || chr(10) || 'URL: ' || url || chr(10) || 'Title: '
    || coalesce(nullif(title, ''), '(none)') || chr(10) || 'Company: ' || company || chr(10)
    || 'Location: ' || location_text || chr(10) || CASE WHEN about <> '' THEN 'Job Description:' || chr(10)
    || about ELSE 'Job Description: (empty)' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)"""


@query(f"WITH {_PACKED} SELECT batch, count(*) AS n, md5({_TEXT}) AS digest FROM p GROUP BY batch")
def batch_texts(spark, sf):
    return S.render_batches(S.pack(postings(spark, sf))).select(
        "batch", "n", F.md5("batch_text").alias("digest")
    )


def replies(spark, sf):
    """A reply per document: clean, fenced, inside prose, or wrong, by language."""
    doc = F.col("doc_id").cast("string")
    item = lambda bucket, why: F.struct(
        F.concat(F.lit("https://d.example.com/"), doc).alias("url"), F.lit(bucket).alias("bucket"),
        why.alias("why"), F.lit("Wait\u0001").alias("what_to_do_next"),
    )
    good = F.to_json(F.struct(
        F.array(item("true_match", F.array(F.col("source"), F.lit("b")))).alias("true_matches"),
        F.array(item("reject", F.array(F.col("source")))).alias("rejects"),
        F.lit("a single note").alias("notes"),
    ))
    bad = F.to_json(F.struct(F.array(item("monitor", F.col("source"))).alias("monitor")))
    lang = F.col("lang")
    text = (
        F.when(lang == "en", good)
        .when(lang == "de", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(lang == "es", F.concat(F.lit("Here: "), good, F.lit(" Done.")))
        .otherwise(bad)
    )
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("batch"), F.lit(0).alias("try"), text.alias("text")
    )


@query("""WITH r AS (SELECT *, lang IN ('en', 'de', 'es') AS ok FROM documents)
SELECT doc_id AS batch, ok AS valid, CASE WHEN ok THEN 2 ELSE 0 END AS n_items,
  CASE WHEN ok THEN 'a single note' ELSE '' END AS notes,
  CASE WHEN ok THEN '0/0/true_match/' || source || ',b;2/0/reject/' || source ELSE '' END AS items FROM r""")
def parsed_replies(spark, sf):
    items = F.transform(
        "items",
        lambda i: F.concat_ws("/", i["list"], i["pos"], i["bucket"], F.array_join(i["why"], ",")),
    )
    return S.parse_replies(replies(spark, sf)).select(
        "batch", "valid", F.size("items").alias("n_items"),
        F.array_join("notes", "|").alias("notes"), F.array_join(items, ";").alias("items"),
    )


_CLOSED = "contains(lower(text), 'ndsh')"


@query(f"""WITH d AS (SELECT doc_id, lang, source, {_CLOSED} AS closed FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM d WHERE NOT closed),
p AS (SELECT *, i // 10 AS batch, i % 10 + 1 AS place FROM o),
v AS (SELECT batch, arg_min(lang, place) = 'en' AS ok FROM p GROUP BY batch),
s AS (SELECT 'https://d.example.com/' || doc_id AS url, 2 AS list, 0 AS part, 0 AS batch, doc_id AS pos,
    'reject' AS bucket, 'Role is closed: no longer accepting applications' AS why, 'Skip' AS what_to_do_next
  FROM d WHERE closed
  UNION ALL SELECT 'https://d.example.com/' || doc_id, CASE WHEN ok THEN 1 ELSE 2 END, 1, p.batch,
    CASE WHEN ok THEN place - 1 ELSE place END, CASE WHEN ok THEN lang ELSE 'reject' END,
    CASE WHEN ok THEN source ELSE 'Scoring failed: LLM returned invalid JSON' END,
    CASE WHEN ok THEN 'Wait' ELSE 'Review manually' END FROM p JOIN v USING (batch))
SELECT * FROM s""")
def assembled_scores(spark, sf):
    """All scores of a run. A pack is answered well if its first document is English."""
    closed, waiting = S.split_closed(postings(spark, sf), ["ndsh"])
    packed = S.pack(waiting)
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "url", "location_text", "company"))),
        lambda p: F.struct(
            p["url"].alias("url"), p["location_text"].alias("bucket"),
            F.array(p["company"]).alias("why"), F.lit("Wait").alias("what_to_do_next"),
        ),
    )
    answered = packed.groupBy("batch").agg(
        F.to_json(F.struct(items.alias("monitor"))).alias("good"),
        F.min_by("location_text", "place").alias("lang"),
    ).select(
        "batch", F.lit(0).alias("try"),
        F.when(F.col("lang") == "en", F.col("good")).otherwise("no json").alias("text"),
    )
    scored = S.assemble(closed, packed, S.parse_replies(answered))
    return scored.select(
        "url", "ord.*", "bucket", F.array_join("why", "|").alias("why"), "what_to_do_next"
    )


@query(f"""WITH {_PACKED}, k AS (SELECT batch, count(*) AS n, max(length(about)) AS longest FROM p GROUP BY batch)
SELECT batch, CASE WHEN longest >= 6000 THEN 1 ELSE 0 END AS try, n AS n_items FROM k""", ints="n_items")
def scored_packs(spark, sf):
    """A user function on every pack; packs with a very long text are refused at first."""
    import json

    def answer(pack, attempt):
        if attempt == 0 and pack["job_description"].str.len().max() >= 6000:
            return "not now"
        rows = [
            {"url": u, "bucket": "monitor", "why": ["seen"], "what_to_do_next": "Wait"}
            for u in pack["url"]
        ]
        return json.dumps({"monitor": rows})

    return S.score(S.pack(postings(spark, sf)), answer).select(
        "batch", "try", F.size("items").alias("n_items")
    )


@query(f"""WITH {_PACKED}, k AS (SELECT batch, count(*) AS n, min(place) AS place FROM p GROUP BY batch)
SELECT batch, CAST(unnest([0, 1]) AS INTEGER) AS pos,
  unnest(['pack of ' || n, CASE WHEN batch % 2 = 0 THEN 'even' ELSE 'odd' END]) AS note FROM k WHERE batch % 3 <> 0
UNION ALL SELECT batch, CAST(0 AS INTEGER), 'Scoring parse error - review jobs manually' FROM k WHERE batch % 3 = 0""")
def digest_notes(spark, sf):
    """Notes of all packs in order; every third reply is no JSON."""
    import json

    def answer(pack, attempt):
        batch = int(pack["batch"].iloc[0])
        if batch % 3 == 0:
            return "none"
        return json.dumps({"notes": [f"pack of {len(pack)}", "odd" if batch % 2 else "even"]})

    return S.digest_notes(S.score(S.pack(postings(spark, sf)), answer))


@query(f"""WITH {_PACKED}, k AS (SELECT batch, arg_min(url, place) AS url FROM p GROUP BY batch)
SELECT url, 'monitor' AS bucket, 'Job 1:' || chr(10) || 'URL: ' || url || '|Learned from your feedback:' || chr(10)
  || 'Reject these companies: src1, src2' || chr(10) || chr(10) AS why FROM k""")
def scored_with_preferences(spark, sf):
    """A function that repeats what it is told: the start of a pack's text, and the preferences."""
    import json

    from postmill.plans.stages import Scorer, score_stage

    def answer(pack, attempt):
        told = pack["batch_text"].iloc[0]
        why = ["\n".join(told.split("\n")[:2]), pack["preferences"].iloc[0]]
        item = {"url": pack["url"].iloc[0], "bucket": "monitor", "why": why, "what_to_do_next": ""}
        return json.dumps({"monitor": [item]})

    prefs = load(spark, sf, "documents").filter("source in ('src1', 'src2')").select(
        F.lit("me").alias("owner"), F.lit("reject").alias("kind"), F.col("source").alias("value"),
    ).distinct().withColumn("seq", F.lit(0).cast("bigint"))
    table = postings(spark, sf).select(
        "seq", F.lit("s").alias("source"), F.col("url").alias("job_url"), F.lit("fetched").alias("fetch_status"),
        F.col("title").alias("role_title"), "company", F.col("location_text").alias("location"), "job_description",
        F.lit("").alias("agent_bucket"), F.lit("").alias("agent_reasoning"),
    )
    _, scored, _ = score_stage(table, Scorer(fn=answer, prefs=prefs))
    return scored.filter("what_to_do_next = ''").select("url", "bucket", F.array_join("why", "|").alias("why"))


RULES = [
    S.Rule("long words", "reject", any_of=["ndsh", "edea"], overridable=True),
    S.Rule("infrastructure", "reject", all_of=["token", "="]),
    S.Rule("greenfield", "true_match", all_of=["the", "and"], any_of=["thnd", "einer"]),
]
_PATTERNS = ["Ouèelle"]


def source_preferences(spark, sf):
    """A source is rejected for much toxic text and an exception for little."""
    toxic = load(spark, sf, "labels").join(
        load(spark, sf, "documents").select("doc_id", "source"), "doc_id"
    ).groupBy("source").agg(F.sum("toxic").alias("t"))
    return toxic.select(
        F.col("source").alias("value"),
        F.when(F.col("t") >= 4, "reject").when(F.col("t") <= 1, "exception").otherwise("note")
        .alias("kind"),
    )


@query("""WITH t AS (SELECT source, sum(toxic) AS t FROM labels JOIN documents USING (doc_id) GROUP BY source),
d AS (SELECT doc_id, t.t, lower(CASE WHEN lang = 'en' THEN 'Doc ' || doc_id ELSE '' END || ' ' || text || ' ' || lang) AS w
  FROM documents LEFT JOIN t USING (source)),
v AS (SELECT doc_id, CASE
  WHEN contains(w, 'no longer accepting applications') OR contains(w, 'applications are closed')
    OR contains(w, 'role is closed') THEN ['reject', 'Role is closed: no longer accepting applications']
  WHEN contains(w, 'ouèelle') THEN ['reject', 'pattern: Ouèelle']
  WHEN t >= 4 THEN ['reject', 'entity: reject']
  WHEN (contains(w, 'ndsh') OR contains(w, 'edea')) AND NOT coalesce(t <= 1, false) THEN ['reject', 'rule: long words']
  WHEN contains(w, 'token') AND contains(w, '=') THEN ['reject', 'rule: infrastructure']
  WHEN contains(w, 'the') AND contains(w, 'and') AND (contains(w, 'thnd') OR contains(w, 'einer'))
    THEN ['true_match', 'rule: greenfield']
  ELSE ['monitor', 'no rule fired'] END AS x FROM d)
SELECT doc_id AS seq, x[1] AS bucket, '• ' || x[2] AS reasons FROM v""")
def rule_buckets(spark, sf):
    ruled = S.bucket_by_rules(
        postings(spark, sf), RULES, source_preferences(spark, sf), _PATTERNS
    )
    return ruled.select("seq", "bucket", render_reasons("why").alias("reasons"))


@query("""WITH p AS (SELECT item_id, substr(text, 11, 16) AS shown, lower(substr(text, 11, 16)) AS p FROM benchmark
  WHERE regexp_matches(substr(text, 11, 16), '[^ ]')),
d AS (SELECT doc_id, lower(CASE WHEN lang = 'en' THEN 'Doc ' || doc_id ELSE '' END || ' ' || text || ' ' || lang) AS w FROM documents),
h AS (SELECT doc_id, arg_min(shown, item_id) AS shown FROM d JOIN p ON contains(w, p) GROUP BY doc_id),
v AS (SELECT doc_id, CASE
  WHEN contains(w, 'no longer accepting applications') OR contains(w, 'applications are closed')
    OR contains(w, 'role is closed') THEN ['reject', 'Role is closed: no longer accepting applications']
  WHEN shown IS NOT NULL THEN ['reject', 'pattern: ' || shown] ELSE ['monitor', 'no rule fired'] END AS x
  FROM d LEFT JOIN h USING (doc_id))
SELECT doc_id AS seq, x[1] AS bucket, '• ' || x[2] AS reasons FROM v""")
def pattern_table_buckets(spark, sf):
    """Learned patterns as a table: some characters out of each benchmark text, the first found counts."""
    patterns = load(spark, sf, "benchmark").select(
        F.col("item_id").alias("seq"), F.substring("text", 11, 16).alias("pattern"))
    ruled = S.bucket_by_rules(postings(spark, sf), [], None, patterns)
    return ruled.select("seq", "bucket", render_reasons("why").alias("reasons"))


def labelled(spark, sf):
    """Every document with the bucket its label gives it; most have none and are monitored."""
    labels = load(spark, sf, "labels")
    return load(spark, sf, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://d.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "true_match")
        .otherwise("monitor").alias("bucket"),
        F.array("source", "lang").alias("why"),
    )


_LABELLED = """b AS (SELECT doc_id, 'https://d.example.com/' || doc_id AS url,
    CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'true_match' ELSE 'monitor' END AS bucket,
    '• ' || source || chr(10) || '• ' || lang AS reasons
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_LABELLED} SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS place,
  url, reasons FROM b""")
def bucket_digest(spark, sf):
    return list_buckets(labelled(spark, sf))


@query(f"WITH {_LABELLED} SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def bucket_counts(spark, sf):
    return count_buckets(labelled(spark, sf))


@query("SELECT doc_id AS seq, left(text, 500) AS summary FROM documents")
def doc_previews(spark, sf):
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        summary("text").alias("summary"),
    )
