"""The archive, vector search, the mixture and the pipeline."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from postmill.llm import archive, mixing, vectors
from postmill.llm.queries import ORACLES, QUERIES, TARGETS
from tests.llm import cases

PAGES = "page_id bigint, url string, html string"
LONG = "<p>é</p>" + "x" * 200


def awkward_pages():
    return [
        (4, "http://a/\r\nX: y", LONG), (2, None, LONG), (9, "u", LONG + "."), (7, "u", None), (8, "u", ""),
        (5, "u", "short"), (6, "u", "short"), (2, "twice", LONG), (None, "u", LONG), (10, "u", "WARC/1.1\r\n\r\n" * 30),
        (11, "u", "\r\n\r\n" + "y" * 100_000), (12, "u", "\r\n\r\n" + "y" * 100_000),
    ]


def test_archive_of_awkward_pages(spark, tmp_path):
    pages = cases.clashing(spark, spark.createDataFrame(awkward_pages(), PAGES), ["digest", "size", "payload"])
    archive.write(pages, f"file://{tmp_path}/a")
    payload = {p: (h or "").encode() for p, _, h in awkward_pages()}
    by_id = {p: hashlib.sha256(b).hexdigest() for p, b in payload.items()}
    found = cases.rows(archive.catalogue(spark, f"file://{tmp_path}/a"))
    assert Counter(r["page_id"] for r in found) == Counter(p for p, *_ in awkward_pages())
    for r in found:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload[r["page_id"]]), by_id[r["page_id"]])
    refers = {r["page_id"]: r["refers_to"] for r in found if r["record_type"] == "revisit"}
    assert refers == {4: 2, None: 2, 12: 11}
    whole = cases.rows(archive.restored(spark, f"file://{tmp_path}/a"))
    assert Counter((r["page_id"], bytes(r["payload"])) for r in whole) == Counter(
        (p, (h or "").encode()) for p, _, h in awkward_pages()
    )
    heads = {r["page_id"]: bytes(r["header"]) for r in whole}
    assert b"WARC-Target-URI: http://a/%0D%0AX: y" in heads[4] and b"Content-Length: 0" in heads[4]
    assert heads[11].startswith(b"WARC/1.1\r\nWARC-Type: response")
    stored = archive._payloads(spark, f"file://{tmp_path}/a", True).collect()
    assert len(stored) == len({r.digest for r in stored}) == len(set(by_id.values()))


def test_files_of_an_archive_are_bounded_by_bytes(spark, tmp_path):
    """Pages of 1 MB and of 5 MB beside small ones: few records to a file, and all are read back."""
    sizes = {k: 1_000_000 + k for k in range(70)} | {100: 5_000_000, 101: 5_000_001} | {200 + k: 50 + k for k in range(30)}
    pages = spark.createDataFrame([(k, n) for k, n in sizes.items()], "page_id bigint, n int").selectExpr(
        "page_id", "'u' as url", "repeat(char(97 + page_id % 26), n) as html").coalesce(2)
    archive.write(pages, f"file://{tmp_path}/a")
    found = {r.page_id: r.payload_bytes for r in archive.catalogue(spark, f"file://{tmp_path}/a").collect()}
    assert found == sizes
    held = [[n for _, n in archive.parsed(f.read_bytes(), True)] for f in (tmp_path / "a" / "payloads").glob("part-*")]
    each = [sum(map(len, bodies)) for bodies in held]
    assert max(each) <= 32 * 1_000_069 and sum(map(len, held)) == len(sizes)
    assert [len(b) for b in held if any(len(x) > 1 << 22 for x in b)] == [1, 1]


def test_empty_archive(spark, tmp_path):
    archive.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/b")
    assert archive.catalogue(spark, f"file://{tmp_path}/b").collect() == []


def test_archive_agrees_with_sql(spark):
    table = [r.asDict() for r in spark.read.parquet(f"{cases.SF}/pages.parquet").collect()]
    assert cases.spark_rows(QUERIES["op6_warc_archive"](spark, cases.SF)) == cases.sql_rows(
        ORACLES["op6_warc_archive"], pages=table
    )


# --- vectors ---------------------------------------------------------------------------------------

def plain_nearest(table, queries, k):
    out = {}
    for q, v in queries:
        scored = [(-float(np.dot(v, x)) / (math.sqrt(np.dot(v, v)) * math.sqrt(np.dot(x, x))), i) for i, x in table if i != q]
        out[q] = sorted(scored)[:k]
    return out


def test_all_is_found_where_all_is_seen(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(12)]  # equal vectors: ties go to smaller ids
    odd = [(200, None), (201, [0.0] * 6), (202, [None] + [1.0] * 5), (203, [float("nan")] + [1.0] * 5),
           (204, [float("inf")] * 6), (205, [1.0, 2.0]), (None, [1.0] * 6)]
    table = cases.clashing(spark, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>"), ["id", "v", "score"])
    found = cases.rows(vectors.nearest(table, table, k=5, centroids=4))
    expected = plain_nearest(*[[(i, np.array(v, float)) for i, v in rows]] * 2, 5)
    assert {r["query_id"] for r in found} == expected.keys()
    for q, best in expected.items():
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r["vec_id"] for r in mine] == [i for _, i in best]
        assert np.allclose([r["score"] for r in mine], [-s for s, _ in best], rtol=0, atol=1e-12)


def test_queries_of_one_centroid_are_dealt_to_lanes(spark, monkeypatch):
    """With small blocks: many groups meet, none has more than two lanes' rows, and all is found."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "LANE_BLOCKS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sizes = []
    settled = vectors.settle

    def seen(df):
        done = settled(df)
        if "q_lane" in done.columns:
            n = next(c for c in ("xs", "qs") if c in done.columns)
            sizes.append({(r.i, r.lane, r.q_lane): r.n for r in done.selectExpr("i", "lane", "q_lane", f"size({n}) n").groupBy(
                "i", "lane", "q_lane").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()})
        return done

    monkeypatch.setattr(vectors, "settle", seen)
    found = cases.rows(vectors.nearest(table, table, k=5, centroids=2, share=1.0))
    xs, qs = sizes
    assert max(xs.values()) <= 40 and max(qs.values()) <= 40 and len(xs.keys() & qs.keys()) > 20
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    score = unit @ unit.T - 9 * np.eye(len(rows))
    for r in found:
        assert np.argsort(-score[r["query_id"]], kind="stable")[r["rank"] - 1] == r["vec_id"]
    assert len(found) == 600


def test_small_and_empty_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in vectors.nearest(two, two).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    none = spark.createDataFrame([], schema)
    assert vectors.nearest(none, none).collect() == [] and vectors.nearest(two, none).collect() == []
    one = two.filter("vec_id = 0")
    assert vectors.nearest(one, one).collect() == []


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(3)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    cells = vectors.visited(a, b, counts, 40)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and sum(counts[c] for c in cells) >= 40 > sum(counts[c] for c in cells[:-1])
    assert len(vectors.visited(a, b, counts, 10**9)) == (counts > 0).sum()


def test_recall_over_a_larger_table(spark):
    spark.sparkContext.setLogLevel("OFF")
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    asked = np.flatnonzero(ids % 50 == 0)
    s = vectors.cosines(x[asked], x)
    s[ids[asked][:, None] == ids[None]] = -np.inf
    true = {int(ids[q]): set(ids[np.argsort(-s[k])[:5]].tolist()) for k, q in enumerate(asked)}
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    # asked of a smaller share at a time, so that the search does not simply see all
    found = vectors.nearest(table, table.filter("vec_id % 50 = 0"), least_seen=100).collect()
    hits = sum(r.vec_id in true[r.query_id] for r in found)
    assert len(found) == 5 * len(true) and hits >= 0.9 * len(found)


# --- mixing ----------------------------------------------------------------------------------------

def plain_rates(n, p, aim, ridge=mixing.RIDGE):
    """Least squares by many small steps, all in one array."""
    tokens = n.sum()
    r = np.ones(len(n))
    bend = tokens * (p / aim).T @ (p / aim * n[:, None])
    pace = 1 / (bend.sum(axis=1).max() + ridge)
    for _ in range(4000):
        e = (n * r) @ p / aim - 1
        r = np.maximum(0, r - pace * (tokens * (p / aim) @ e + ridge * (r - 1)))
    return r


def test_rates_meet_the_targets_and_agree_with_plain_least_squares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labelled = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left_semi").selectExpr("doc_id", "lang as domain")
    rows = mixing.rates(docs, labelled, TARGETS).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    names = list(TARGETS)
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    rate = np.array([r.rate for r in rows])
    aim = n.sum() * np.array([TARGETS[d] for d in names])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((n * rate) @ p / aim, 1, atol=1e-3)
    assert np.abs(rate - plain_rates(n, p, aim)).max() < 0.01
    long = [r for r in rows if r.n_tokens >= 30]
    assert sum(r[f"p_{r.lang}"] > 0.5 for r in long) >= 0.98 * len(long)
    assert all(math.floor(r.rate) <= r["take"] <= math.floor(r.rate) + 1 for r in rows)
    assert abs(np.array([r["take"] for r in rows]).mean() - rate.mean()) < 0.05


def test_very_rare_domains_meet_their_targets(spark):
    sizes = {"en": 800, "de": 100, "fr": 99, "es": 1}
    names = [d for d, k in sizes.items() for _ in range(k)]
    data = [(i, " ".join(f"{d}{(i + j) % 50}" for j in range(40)), d, "s", 0) for i, d in enumerate(names)]
    docs = cases.documents(spark, data)
    rows = cases.rows(mixing.rates(docs, docs.selectExpr("doc_id", "lang as domain"), TARGETS))
    total = sum(r["n_tokens"] for r in rows)
    for d, w in TARGETS.items():
        assert abs(sum(r["n_tokens"] * r["rate"] * r[f"p_{d}"] for r in rows) / total / w - 1) < 1e-3


def test_targets_that_cannot_be_met_are_warned_of(spark):
    docs = cases.documents(spark, [(i, "en one two", "en", "s", 0) for i in range(20)])
    with pytest.warns(UserWarning, match="cannot be met"):
        mixing.rates(docs, docs.selectExpr("doc_id", "lang as domain"), {"en": 1.0, "de": 3.0}).collect()


def test_a_rate_stops_at_zero():
    n, p = np.array([10.0, 10.0, 10.0]), np.array([[1, 0], [0.5, 0.5], [0, 1]])
    assert plain_rates(n, p, np.array([29.0, 1.0]))[2] == 0


def test_mixture_of_awkward_rows(spark):
    docs = cases.clashing(spark, cases.documents(spark), ["rate", "take", "p_en", "bucket"])
    labelled = spark.createDataFrame([(9, "en"), (7, "de"), (None, "en"), (5, None), (6, "xx")], "doc_id bigint, domain string")
    made = cases.rows(mixing.rates(docs, labelled, {"en": 1.0, "de": 1.0, "fr": 0.0}))
    distinct = {(i, t) for i, t, *_ in cases.awkward()}
    assert len(made) == len(distinct)
    assert all(r["rate"] >= 0 and abs(r["p_en"] + r["p_de"] - 1) < 1e-9 for r in made)
    assert Counter(r["n_tokens"] for r in made) == Counter(len((t or "").encode().split()) for _, t in distinct)
    mixed = mixing.mixed(docs, labelled, {"en": 1.0, "de": 1.0})
    assert mixed.columns == docs.columns
    times = Counter(map(tuple, mixed.select("doc_id", "text").collect()))
    own = Counter((i, t) for i, t, *_ in cases.awkward())
    assert all(n % own[k] == 0 for k, n in times.items())
    empty = cases.documents(spark, [])
    assert mixing.mixed(empty, labelled, TARGETS).collect() == []
    blank = cases.documents(spark, [(1, "", "en", "s", 0), (2, None, "en", "s", 0)])
    assert [r.rate for r in mixing.rates(blank, labelled, TARGETS).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        mixing.rates(blank, labelled, {"en": 0.0})


def test_main_path_runs_no_python(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labelled = docs.selectExpr("doc_id", "lang as domain")
    plan = mixing.memberships(docs, labelled, list(TARGETS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- the pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.settle(stage(spark, docs, cases.SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    made = pipeline.STAGES[-1][1](spark, docs, cases.SF)
    assert made.count() == counts[4]
    again = pipeline.run(spark, cases.SF)
    assert cases.spark_rows(made) == cases.spark_rows(again)
