"""The operators bound to the test tables with production parameters, and SQL where it can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    archive, cells, licences, mixing, packed, periods, quality, repetition, simhash, substrings, tokens,
    vectors, windows,
)
from postmill.llm.common import load
from postmill.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Weights of the languages in the mixture.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
END_ID = 0


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def folder(spark: SparkSession, name: str) -> str:
    """A new one in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def labelled_languages(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    """The labelled table of the mixing: documents that have labels, with their language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(
        load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    )


@query()
def op1_mixing_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return mixing.rates(docs, labelled_languages(spark, sf, docs), TARGETS).drop("th")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RUNS = f"""w AS MATERIALIZED (
  SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM documents),"""


def _window(n: int) -> str:
    return f"""(SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS run FROM w)"""


_SYMBOLS = " + ".join(
    f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', ''))" for c in repetition.SYMBOLS
)


@query(f"""
WITH {_RUNS}
r8 AS (SELECT doc_id, pos FROM (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(run, ' '))) AS c
    FROM {_window(repetition.SHORTEST)} WHERE len(run) = {repetition.SHORTEST}) WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, pos + d AS p FROM r8, range({repetition.SHORTEST}) AS t(d)) GROUP BY doc_id),
long AS (SELECT DISTINCT doc_id FROM (
    SELECT doc_id, md5(array_to_string(run, ' ')) AS h FROM {_window(repetition.LONGEST_WORDS + 1)}
    WHERE len(run) = {repetition.LONGEST_WORDS + 1}) GROUP BY doc_id, h HAVING count(*) > 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST({_SYMBOLS} AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, long.doc_id IS NOT NULL AS long
  FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id)),
judged AS (SELECT *, n_words < {repetition.LEAST_WORDS}
    OR 100 * n_repeat_words > {repetition.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT long AND 100 * n_repeat_words <= {repetition.COVERED_PERCENT} * n_words AS kept
FROM judged""")
def op2_suffix_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.judged(load(spark, sf, "documents")).drop("longest_repeat")


@query()
def op3_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return quality.scores(docs, quality.fit(docs, load(spark, sf, "labels")))


@query()
def op4_inverted_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    table = load(spark, sf, "embeddings")
    return vectors.nearest(table, table.filter("vec_id % 50 = 0"))


@query()
def op5_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokens.digests(load(spark, sf, "documents"), path, public_tokenizers.PATTERN)


@query(f"""
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
  sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN shared AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN shared AND page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first,
  octet_length(encode(coalesce(html, ''))) >= {archive.LEAST_SHARED_BYTES} AS shared FROM pages)""")
def op6_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    place = folder(spark, "warc")
    archive.write(load(spark, sf, "pages"), place)
    return archive.catalogue(spark, place)


@query()
def op7_packed_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    place = folder(spark, "packed")
    packed.write(
        load(spark, sf, "documents"), place, public_tokenizers.path("byte_bpe_50k.json"), END_ID
    )
    return packed.index(spark.read.schema(packed.SEGMENT).parquet(place))


@query(f"""
WITH {_RUNS}
runs AS MATERIALIZED (SELECT doc_id, pos, md5(array_to_string(run, ' ')) AS h
  FROM {_window(substrings.WINDOW)} WHERE len(run) = {substrings.WINDOW}),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM runs)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, range({substrings.WINDOW}) AS t(d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(counts.n, 0) AS n_words, coalesce(counts.n, 0) - coalesce(kept.n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""")
def op8_seed_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.removal_digests(load(spark, sf, "documents"))


@query()
def op9_simhash_trie(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scanned(load(spark, sf, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: where h = crc32 of the decimal doc_id is divisible by ten, the words from the
    (g % n)-th on repeat their first 1 + (n - a) / (3 + g % 8), with g = h / 10; other texts (and those
    without a doc_id) as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = some.select("doc_id", "text", "g", F.when(F.col("g").isNotNull(), split).alias("w"))
    some = some.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    some = some.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    planted = F.expr("""array_join(concat(slice(w, 1, a),
        slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')""")
    return some.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(planted).alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periods.collapsed(with_planted_runs(load(spark, sf, "documents"))).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _rounds(n: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of n rounds; c0 and the vectors v are given."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, vec_id, v, m.k AS k, m.d AS d FROM (
    SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS m FROM (
      SELECT id, vec_id, v, k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)]) AS d
      FROM v, c{r}) GROUP BY id))""")
        if r < n:
            steps.append(f"""m{r} AS (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY p) AS c FROM (
    SELECT k, p, sum(x) AS s, count(*) AS n FROM (
      SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) GROUP BY k, p) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return ",\n".join(steps)


@query(f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id,
    [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c
  FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 8)),
{_rounds(10)},
done AS (SELECT vec_id, k, d, c FROM (SELECT vec_id, d, k FROM a10) JOIN c10 USING (k))
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM done""")
def op12_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cells.clusters(load(spark, sf, "embeddings"))


PACKED_END_ID = 1


@query()
def op13_window_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return windows.packed(load(spark, sf, "documents"), path, PACKED_END_ID).drop("ids")
