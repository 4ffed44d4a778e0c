"""Mixing to target weights with soft membership, in built-in functions only.

A naive Bayes classifier, learned from a labelled table, gives each document a posterior for every
domain. Its tokens count towards each domain by these. Then rates are fitted, one a document and not
negative, by projected-gradient least squares: the expected tokens of each domain shall match its
target, and rates stay as near to 1 as that allows. A step needs, of all documents, only the expected
totals (a number a domain), and changes each rate by its own posteriors. Where many steps do not meet
the targets (very rare domains), Newton's steps go on from the same problem's dual, which has a number
a domain; what then remains cannot be met, and is reported by a warning."""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded_ids, free_name, settle

#: Labelled documents that the classifier learns from, and buckets that words are hashed to.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 14
#: A document counts as at most so many independent words, so that posteriors stay soft.
EFFECTIVE_WORDS = 30.0
SMOOTHING = 0.5
#: Weight of the pull of each rate towards 1; stops of the descent.
RIDGE = 1e-5
TOLERANCE = 1e-4
MOST_STEPS = 200
STEPS_AT_ONCE = 10
#: Steps that the dual's minimum is given for each weight of the pull; they are few (some ten).
NEWTON_STEPS = 100


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: str = "word") -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def learned(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS):
    """(weights, priors): `weights` has a row for each of BUCKETS buckets at most, with the
    logarithm of a domain's share of the bucket in column l0, l1, ... in the order of `domains`;
    `priors` are the logarithms of the domains' shares of the sample.

    labelled: doc_id, domain; other domains and nulls are not used. Without any sample row all
    domains are alike."""
    known = labelled.filter(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = bounded_ids(known, "doc_id", rows)  # at most `rows` ids: what is broadcast is bounded
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").join(known, "doc_id"))
    shares = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    seen = sample.select("domain", F.explode(_words()).alias("word")).groupBy(_bucket().alias("bucket")).agg(*(
        F.sum((F.col("domain") == d).cast("bigint")).alias(f"c{k}") for k, d in enumerate(domains)
    ))
    seen = settle(seen)
    totals = seen.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(len(domains)))).first()
    weights = seen.select("bucket", *(
        (F.log(F.col(f"c{k}") + SMOOTHING) - math.log(n + SMOOTHING * BUCKETS)).alias(f"l{k}")
        for k, n in enumerate(totals)
    ))
    # a bucket the sample lacks: the same for all words, but not for all domains
    unseen = [math.log(SMOOTHING) - math.log(n + SMOOTHING * BUCKETS) for n in totals]
    whole = sum(shares.values()) + len(domains)
    return weights, unseen, [math.log((shares.get(d, 0) + 1) / whole) for d in domains]


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, th (hash of the text), n_tokens, p0, p1, ...: posteriors of the domains, in order.

    A text without words (null, empty) has the shares of the sample for posteriors. Rows equal in
    doc_id and text are one row with `copies`, how many they are."""
    weights, unseen, priors = learned(docs, labelled, domains, rows)
    n = range(len(domains))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    words = texts.select("doc_id", "th", F.explode_outer(_words()).alias("word")).select(
        "doc_id", "th", "word", _bucket().alias("bucket")
    )
    # `weights` has BUCKETS rows of numbers at most, however large the corpus
    scored = words.join(F.broadcast(weights), "bucket", "left").groupBy("doc_id", "th").agg(
        F.count("word").alias("w"),
        *(F.sum(F.when(F.col("word").isNotNull(), F.coalesce(f"l{k}", F.lit(unseen[k])))).alias(f"s{k}") for k in n),
    )
    copies = docs.select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th").agg(F.count("*").alias("copies"))
    both = scored.join(copies, scored["doc_id"].eqNullSafe(copies["doc_id"]) & (scored["th"] == copies["th"])).select(
        scored["*"], "copies"
    )
    shrink = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.lit(EFFECTIVE_WORDS) / F.col("w"))).otherwise(0.0)
    logs = both.withColumns({f"s{k}": F.coalesce(F.col(f"s{k}") * shrink, F.lit(0.0)) + priors[k] for k in n})
    most = F.greatest(*(f"s{k}" for k in n)) if len(domains) > 1 else F.col("s0")
    raised = logs.withColumn("most", most).withColumns({f"e{k}": F.exp(F.col(f"s{k}") - F.col("most")) for k in n})
    total = _sum([F.col(f"e{k}") for k in n])
    return raised.select(
        "doc_id", "th", "copies", (F.col("w") / F.col("copies")).cast("bigint").alias("n_tokens"),
        *((F.col(f"e{k}") / total).alias(f"p{k}") for k in n),
    )


def _totals(rows: DataFrame, n: range, rate: Column) -> list[float]:
    tokens = F.col("n_tokens") * F.col("copies") * rate
    got = rows.agg(*(F.coalesce(F.sum(tokens * F.col(f"p{k}")), F.lit(0.0)) for k in n)).first()
    return [float(x) for x in got]


def _largest_eigenvalue(m: list[list[float]]) -> float:
    """Of a symmetric matrix without negative entries, from above: its largest row sum."""
    return max(map(sum, m))


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, th, n_tokens, p_<domain>..., rate, take: a row for each (doc_id, text) of docs.

    targets: domain to weight; they are scaled to sum to 1. The targets in tokens are these shares
    of `total` (default: the tokens of docs). Expected tokens of a domain: the sum over rows of
    n_tokens * p * rate. `take`: how many copies of each row the rate stands for, a whole number,
    at random by a hash of doc_id and text, so that it is the same each time and right on average.
    Domains with no weight are left out; without any the result is an error. A table whose tokens
    are none, or an empty one, has rate 1 throughout. Targets that no rates meet (a domain that no
    document belongs to, say) are met as nearly as least squares can, with a warning that says by
    how much they are missed."""
    chosen = {d: w for d, w in targets.items() if w > 0}
    if not chosen:
        raise ValueError("no domain has a weight above zero")
    domains, n = list(chosen), range(len(chosen))
    weights = [w / sum(chosen.values()) for w in chosen.values()]
    rows = settle(memberships(docs, labelled, domains))
    tokens = sum(_totals(rows, n, F.lit(1.0)))
    fitted = rows.withColumn("rate", F.lit(1.0))
    if tokens > 0:
        aim = [(total if total is not None else tokens) * w for w in weights]
        fitted = _descended(rows, n, aim, tokens)
    draw = F.pmod(F.xxhash64("doc_id", "th", F.lit("take")), F.lit(1 << 53)) / float(1 << 53)
    return fitted.select(
        "doc_id", "th", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in zip(n, domains, strict=True)),
        "rate", F.floor(F.col("rate") + draw).cast("bigint").alias("take"),
    )


def _descended(rows: DataFrame, n: range, aim: list[float], tokens: float) -> DataFrame:
    """Projected gradient descent on half the squared relative errors of the totals, plus the ridge
    (tokens / 2) * sum of (share of tokens) * (rate - 1)^2, in the metric of the documents' tokens:
    the tokens cancel out of a step, which so depends on posteriors and rate alone."""
    share = F.col("n_tokens") * F.col("copies")
    cross = rows.agg(*(F.coalesce(F.sum(share * F.col(f"p{a}") * F.col(f"p{b}")), F.lit(0.0)) for a in n for b in n)).first()
    bend = [[tokens * cross[a * len(n) + b] / (aim[a] * aim[b]) for b in n] for a in n]
    pace = 1 / (_largest_eigenvalue(bend) + RIDGE)
    state, rate, pending = rows.withColumn("rate", F.lit(1.0)), F.col("rate"), 0
    before, met = [math.inf for _ in n], False
    for _ in range(MOST_STEPS):
        # one aggregate over a narrow table: a number a domain comes back, whatever the corpus
        errors = [got / a - 1 for got, a in zip(_totals(state, n, rate), aim, strict=True)]
        moved = max(abs(e - b) for e, b in zip(errors, before, strict=True))
        met = max(map(abs, errors)) < TOLERANCE
        if met or moved < TOLERANCE / 100:
            break
        before = errors
        pull = _sum([F.col(f"p{k}") * (tokens * errors[k] / aim[k]) for k in n])
        rate = F.greatest(F.lit(0.0), rate * (1 - pace * RIDGE) + (pace * RIDGE - pull * pace))
        pending += 1
        if pending == STEPS_AT_ONCE:
            state, rate, pending = settle(state.withColumn("rate", rate)), F.col("rate"), 0
    if not met:
        return _by_newton(rows, n, aim, tokens)
    return settle(state.withColumn("rate", rate)) if pending else state


def _by_newton(rows: DataFrame, n: range, aim: list[float], tokens: float) -> DataFrame:
    """The minimum that `_descended` goes to, by its dual: the rates there are
    max(0, 1 + sum of dual * posterior), and the dual, a number a domain, is where a convex function
    is least. A step is one aggregate. The pull towards 1 is lightened while it keeps targets from
    being met; a target that is missed even so cannot be met, and is warned of."""
    share, goal = F.col("n_tokens") * F.col("copies") / tokens, np.array(aim) / tokens

    def rate(dual: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) + _sum([F.col(f"p{k}") * float(dual[k]) for k in n]))

    def measured(dual: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        r = rate(dual)
        live = share * (r > 0).cast("double")
        got = list(rows.agg(
            F.sum(share * r * r), *(F.sum(share * r * F.col(f"p{k}")) for k in n),
            *(F.sum(live * F.col(f"p{a}") * F.col(f"p{b}")) for a in n for b in n),
        ).first())
        totals, bend = np.array(got[1 : len(n) + 1]), np.array(got[len(n) + 1 :]).reshape(len(n), -1)
        pull = ridge * goal**2
        value = got[0] / 2 - goal @ dual + pull @ dual**2 / 2
        return value, totals - goal + pull * dual, bend + np.diag(pull), totals / goal - 1

    dual = np.zeros(len(n))
    for ridge in (RIDGE, RIDGE / 1e2, RIDGE / 1e4):
        value, slope, bend, errors = measured(dual, ridge)
        for _ in range(NEWTON_STEPS):
            if np.abs(errors).max() < TOLERANCE or np.abs(slope / goal).max() < TOLERANCE / 100:
                break
            step, length = np.linalg.solve(bend, -slope), 1.0
            while (new := measured(dual + length * step, ridge))[0] > value + 1e-4 * length * (slope @ step):
                length /= 2
                if length < 1e-6:  # no lower value within the precision of numbers
                    break
            if length < 1e-6:
                break
            dual = dual + length * step
            value, slope, bend, errors = new
        if np.abs(errors).max() < TOLERANCE:
            break
    else:
        missed = ", ".join(f"{e:+.2%}" for e in errors)
        warnings.warn(f"mixing: targets cannot be met; totals differ from them by {missed}", stacklevel=2)
    return settle(rows.withColumn("rate", rate(dual)))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None) -> DataFrame:
    """The rows of docs, each as often as its `take` says; columns as they are, whatever their names."""
    chosen = rates(docs.select("doc_id", "text"), labelled, targets, total).filter("take > 0")
    chosen = settle(chosen.select("doc_id", "th", "take"))
    own = free_name("h", [*docs.columns, *chosen.columns])
    hashed = docs.withColumn(own, F.xxhash64("text"))
    both = hashed.join(chosen, hashed["doc_id"].eqNullSafe(chosen["doc_id"]) & (hashed[own] == chosen["th"]))
    often = F.explode(F.sequence(F.lit(1).cast("bigint"), chosen["take"])).alias(own)
    return both.select(*(docs[f"`{c}`"] for c in docs.columns), often).drop(own)
