"""Quality by compression: dictionaries of good and of bad text, and the difference they make.

A text is compressed with zstandard under either dictionary. The difference of the two sizes, per
byte, says which kind of text it is more like; a logistic curve, fitted on other labelled texts than
the dictionaries were built from, turns it into a probability."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_slice

#: The labelled sample: at most so many texts of either label, of longer ones a piece of so many characters.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 8000
#: Content of a dictionary: pieces of the sample's texts, mixed, up to so many bytes.
DICTIONARY_BYTES = 400_000
PIECE_BYTES = 500
LEVEL = 6
THRESHOLD = 0.7
#: Bytes added to a text's length, so that the ratio of very short ones stays small.
STEADY_BYTES = 200


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


@dataclass
class Scorer:
    """What scoring needs; small whatever the corpus. Without examples of both labels there are no
    dictionaries, and every text gets the share of good labels (0.5 without labels)."""

    prior: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    offset: float = 0.0
    slope: float = 0.0
    _made: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def difference(self, text: str) -> float:
        if self._made is None:
            self._made = tuple(_compressor(d) for d in (self.good, self.bad))
        raw = text.encode()
        good, bad = (len(c.compress(raw)) for c in self._made)
        return (bad - good) / (len(raw) + STEADY_BYTES)

    def score(self, text: str | None) -> float:
        if not self.good:
            return self.prior
        x = self.offset + self.slope * self.difference(text or "")
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _dictionary(texts: list[str]) -> bytes:
    pieces = [
        raw[at : at + PIECE_BYTES]
        for raw in (t.encode() for t in texts) for at in range(0, len(raw), PIECE_BYTES)
    ]
    random.Random(0).shuffle(pieces)
    return b"".join(pieces)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope, by Newton's method with a light pull to zero."""
    scale = max(float(np.abs(x).max()), 1e-9)
    rows = np.stack((np.ones(len(x)), x / scale), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - 1e-3 * beta
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn from `labels` (doc_id, quality) and the texts of a bounded sample of them.

    Held-out ids take no part, nor do null ones, other labels than 0 and 1, or ids with both. The
    sample is those of the smallest hashes; every other one of them builds the dictionaries, the
    rest fits the curve, weighted so that the shares of the labels are those of the whole table. A text
    above SAMPLE_CHARS characters is represented by one of its pieces of that length, drawn by its id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    clean = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2")
    counts = {r.q: r["count"] for r in clean.groupBy("q").count().collect()}
    if len(counts) < 2:
        return Scorer(prior=float(next(iter(counts), 0.5)))
    order = F.xxhash64("doc_id")
    chosen = [
        clean.filter(F.col("q") == q).orderBy(order, "doc_id").limit(rows).select("doc_id", "q") for q in (0, 1)
    ]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows ids and labels at most
    found = docs.select("doc_id", F.col("text")).join(sample, "doc_id").filter(F.length("text") > 0)
    pieces = F.ceil(F.length("text") / F.lit(SAMPLE_CHARS))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("piece")), pieces) * SAMPLE_CHARS + 1
    found = found.withColumn("text", F.substring("text", begin.cast("int"), F.lit(SAMPLE_CHARS)))
    # a doc_id may stand for several rows: one text of each, or the sample would not be bounded
    texts = found.groupBy("doc_id").agg(F.min("q").alias("q"), F.min("text").alias("text"))
    picked = texts.withColumn("h", order).orderBy("h", "doc_id").limit(2 * rows).collect()
    by = {q: [r.text for r in picked if r.q == q] for q in (0, 1)}
    prior = counts[1] / (counts[0] + counts[1])
    if min(map(len, by.values())) < 2:
        return Scorer(prior=prior)
    made = Scorer(prior=prior, good=_dictionary(by[1][::2]), bad=_dictionary(by[0][::2]))
    rest = [(q, t) for q in (0, 1) for t in by[q][1::2]]
    x = np.array([made.difference(t) for _, t in rest])
    y = np.array([q for q, _ in rest], float)
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    made.offset, made.slope = _logistic(x, y, share)
    return made


def scores(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row: whole texts, null as empty.

    Nothing but the text enters a score. held_out of a null doc_id is false. Texts of zero length
    get the score of no difference. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def job(piece: pa.RecordBatch) -> dict:
        made = [held.value.score(t) for t in piece.column("text").to_pylist()]
        return {
            "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": made,
            "predicted": [int(s >= threshold) for s in made],
        }

    flag = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return by_slice(
        docs, ["doc_id", "text", flag], "doc_id bigint, held_out boolean, score double, predicted int", job
    )


def accepted(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    names = docs.columns

    def run(batches):
        from postmill.llm.common import in_slices

        for piece in in_slices(batches):
            keep = [held.value.score(t) >= threshold for t in piece.column("text").to_pylist()]
            yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*(f"`{c}`" for c in names))
