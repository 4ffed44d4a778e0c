from __future__ import annotations

from pyspark.sql import functions as F

from postmill.bindings.base import by_type, load, query
from postmill.operators import prefs as P

_NAMES = dict(view=" AWS ", click="microsoft", error="MSFT", signup="Google LLC\t", purchase="Netflix")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'Amazon' WHEN 'click' THEN 'microsoft'
  WHEN 'error' THEN 'Microsoft' WHEN 'signup' THEN 'Google' ELSE 'Netflix' END AS entity FROM events""")
def canonical_entities(spark, sf):
    named = load(spark, sf, "events").select("event_id", by_type(**_NAMES).alias("entity"))
    return P.canonical_entities(named)


def feedback(spark, sf):
    """Errors reject and purchases except the user; other events name nobody."""
    return load(spark, sf, "events").select(
        F.lit("me").alias("owner"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("error", "purchase"),
               F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(" ").alias("entity"),
        F.when(F.col("event_type") == "error", "reject").otherwise("exception").alias("action"),
    )


_FEEDBACK = """e AS (SELECT event_id AS seq,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'u' || user_id ELSE '' END AS entity,
    CASE WHEN event_type = 'error' THEN 'reject' ELSE 'exception' END AS action FROM events),
f AS (SELECT *, first_value(action) OVER w AS first_action, min(seq) OVER w AS first_seq FROM e
  WINDOW w AS (PARTITION BY entity ORDER BY seq))"""


@query(f"""WITH {_FEEDBACK},
v AS (SELECT seq, entity, action, CASE WHEN entity = '' THEN 'error' WHEN seq = first_seq THEN 'added'
  WHEN action = first_action THEN 'no-op' ELSE 'contradiction' END AS verdict FROM f)
SELECT *, CASE WHEN verdict = 'error' THEN 'Entity is empty after normalization'
  WHEN verdict = 'contradiction' AND action = 'reject' THEN 'Contradiction: ' || entity ||
    ' is in exceptions. Remove from exceptions first, or confirm you want to reject.'
  WHEN verdict = 'contradiction' THEN 'Contradiction: ' || entity ||
    ' is in reject list. Remove from reject first, or confirm you want to add as exception.' END AS message
FROM v""")
def preference_verdicts(spark, sf):
    return P.preference_verdicts(feedback(spark, sf)).drop("owner")


@query(f"""WITH {_FEEDBACK} SELECT DISTINCT entity AS value, first_action AS kind, first_seq AS seq
FROM f WHERE entity <> ''""")
def preference_fold(spark, sf):
    return P.fold_preferences(feedback(spark, sf)).drop("owner")


@query(f"""WITH {_FEEDBACK}, c AS (SELECT DISTINCT entity, first_action FROM f WHERE entity <> ''),
s AS (SELECT c_name AS value, CASE WHEN c_acctbal < 0 THEN 'reject' ELSE 'exception' END AS kind FROM customer
  UNION ALL SELECT 'u' || c_custkey, 'reject' FROM customer UNION ALL SELECT n_name, 'note' FROM nation)
SELECT value, kind FROM s UNION ALL SELECT entity, first_action FROM c
WHERE entity NOT IN (SELECT value FROM s WHERE kind <> 'note')""")
def merged_preferences(spark, sf):
    """Stored preferences come first: feedback cannot turn them."""
    customer = load(spark, sf, "customer")
    me, seq = F.lit("me").alias("owner"), F.col("c_custkey").alias("seq")
    stored = customer.select(
        me, F.when(F.col("c_acctbal") < 0, "reject").otherwise("exception").alias("kind"),
        F.col("c_name").alias("value"), seq,
    ).unionByName(customer.select(
        me, F.lit("reject").alias("kind"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("value"), seq,
    )).unionByName(load(spark, sf, "nation").select(
        me, F.lit("note").alias("kind"), F.col("n_name").alias("value"),
        F.col("n_nationkey").cast("bigint").alias("seq"),
    ))
    return P.merge_preferences(stored, feedback(spark, sf)).select("value", "kind")


@query("""WITH n AS (SELECT role, trim(text) AS value, conv_id * 1000 + turn AS seq FROM conversations)
SELECT role AS owner, value, min(seq) AS seq FROM n WHERE value <> '' GROUP BY 1, 2""")
def note_fold(spark, sf):
    notes = load(spark, sf, "conversations").select(
        F.col("role").alias("owner"), F.concat(F.lit("\t "), "text").alias("value"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )
    return P.fold_notes(notes)


_BLOCK = """p AS (SELECT event_type AS owner, CASE user_id % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'exception' ELSE 'note' END AS kind,
    'u' || user_id AS value, min(event_id) AS seq FROM events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY CASE WHEN kind = 'note' THEN '' ELSE value END, seq) AS n FROM p),
l AS (SELECT owner, string_agg(value, ', ' ORDER BY n) FILTER (kind = 'reject' AND n <= 15) AS rejects,
  string_agg(value, ', ' ORDER BY n) FILTER (kind = 'exception' AND n <= 15) AS excepts,
  string_agg('- ' || value, chr(10) ORDER BY n) FILTER (kind = 'note' AND n <= 10) AS notes FROM r GROUP BY owner)"""


@query(f"""WITH {_BLOCK} SELECT owner, 'Learned from your feedback:' || chr(10) || concat_ws(chr(10),
  'Reject these companies: ' || rejects, 'Exceptions (override category rules): ' || excepts, notes)
  || chr(10) || chr(10) AS block FROM l""")
def preference_blocks(spark, sf):
    """Five owners with many preferences each: lists are cut to their caps."""
    prefs = load(spark, sf, "events").select(
        F.col("event_type").alias("owner"),
        F.when(F.col("user_id") % 3 == 0, "reject").when(F.col("user_id") % 3 == 1, "exception")
        .otherwise("note").alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("value"),
        F.col("event_id").alias("seq"),
    ).groupBy("owner", "kind", "value").agg(F.min("seq").alias("seq"))
    return P.preference_block(prefs)


def feedback_replies(spark, sf):
    uid = F.col("user_id").cast("string")
    obj = lambda action: F.concat(F.lit('{"entity": " u'), uid, F.lit(f'\n ", "action": "{action}"}}'))
    return load(spark, sf, "events").select(
        F.lit("me").alias("owner"), F.col("event_id").alias("seq"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("try"), by_type(
                view=obj("Reject "), click=F.concat(F.lit("```json\n"), obj("exception"), F.lit("\n```")),
                signup=F.concat(F.lit("Sure: "), obj("reject")), purchase=obj("maybe"),
                error='{"entity": "", "action": ""}').alias("reply")),
            F.struct(F.lit(1).alias("try"), by_type(
                view=obj("exception"), signup=obj("reject"), purchase="[]",
                error='{"entity": 7, "action": "reject"}').alias("reply")),
        )).alias("r"),
    ).select("owner", "seq", "r.*")


@query("""SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'u' || user_id END AS entity,
  CASE WHEN event_type IN ('view', 'signup') THEN 'reject' WHEN event_type = 'click' THEN 'exception' END AS action,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'parsed' ELSE 'PARSE_FAILED' END AS status FROM events""")
def feedback_status(spark, sf):
    """Feedback replies with one retry; a control character inside a text is dropped."""
    return P.feedback_status(feedback_replies(spark, sf)).drop("owner")
