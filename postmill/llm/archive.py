"""A content-addressed WARC archive.

Payloads are stored once, under their SHA-256, as WARC resource records; the exact header blocks of
all records stand in files of their own. Spark's text writer makes both (gzip), with the blank line
that ends a WARC record as its separator. Records are put together again by a join on the digest."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import in_slices, settle

#: Payloads shorter than this are never replaced by a reference.
LEAST_SHARED_BYTES = 100
#: A file is read as a whole, so it is bounded by bytes: header blocks of one file, and for payloads of up to
#: so many bytes each the records of one file. Larger payloads have a file of their own.
FILE_HEADERS = 100_000
FILE_PAYLOADS = ((1 << 16, 2000), (1 << 22, 32))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def described(pages: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """page_id, url, digest, size, record_type, refers_to: what becomes of each page.

    Of equal payloads of `least` bytes or more the smallest page_id is the response (all rows that
    have it), others revisit it. A null page_id comes last. That a digest stands for one payload is
    verified by size and a second digest: where they differ, the job ends with an error."""
    raw = F.encode(_payload(), "utf-8")
    # the digests are computed once, and the html goes no further
    narrow = settle(pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.sha2(raw, 256).alias("digest"), F.octet_length(_payload()).cast("bigint").alias("size"),
        F.xxhash64(_payload()).alias("second"),
    ))
    shared = narrow.filter(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"),
        (F.count("*") > F.count("page_id")).alias("nulls"),
        F.min("size").alias("a"), F.max("size").alias("b"),
        F.min("second").alias("c"), F.max("second").alias("d"),
    )
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    shared = settle(shared.select(
        "digest", F.when(same, F.col("first")).otherwise(
            F.raise_error(F.lit("two payloads with one digest")).cast("bigint")
        ).alias("first"),
    ))
    both = narrow.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select(
        "page_id", "url", "digest", "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _block(*fields: tuple[str, Column | str]) -> Column:
    """A header block; a field whose value is null is left out."""
    lines = [
        F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v)) for name, v in fields
    ]
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines)


def _safe(value: Column) -> Column:
    """Without what would end a header line: line breaks as they are written in addresses."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header_blocks(records: DataFrame, date: str) -> DataFrame:
    uri = F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"))
    return records.select(_block(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.coalesce(uri, F.lit("urn:page:")), F.lit(">"))),
        ("WARC-Date", date),
        ("WARC-Target-URI", _safe(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", PROFILE)),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        ("Content-Type", "text/html"),
        ("Content-Length", F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("size")).cast("string")),
    ).alias("value"))


def write(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Archive every row of pages (page_id, url, html) below `folder`; html null is empty.

    `headers`: a block for each row. `payloads`: each distinct payload once. Extra columns are not
    read; an empty table gives an archive without records."""
    records = settle(described(pages))
    options = {"compression": "gzip", "lineSep": _END}
    headers = header_blocks(records, date).write.options(**options, maxRecordsPerFile=FILE_HEADERS)
    headers.text(f"{folder}/headers")
    # one page stands for each payload, so only its html is moved
    chosen = settle(records.groupBy("digest").agg(
        F.min("page_id").alias("page_id"), F.first("size").alias("size")
    ))
    key = F.concat_ws("/", F.coalesce(F.col("page_id").cast("bigint").cast("string"), F.lit("-")), "digest").alias("key")
    # rows that repeat a page_id and its html are one before they are moved; by the same key, so
    # that the join that picks a page for each payload moves no html again
    own = pages.select(
        "page_id", F.sha2(F.encode(_payload(), "utf-8"), 256).alias("digest"), _payload().alias("payload")
    ).select(key, "payload")
    block = _block(
        ("WARC-Type", "resource"),
        ("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("Content-Type", "application/octet-stream"),
        ("Content-Length", F.col("size").cast("string")),
    )
    # one job for each class of sizes that there is, so that a file's records can be counted out
    most = [n for n, _ in FILE_PAYLOADS]
    classed = F.coalesce(*[F.when(F.col("size") <= n, F.lit(k)) for k, n in enumerate(most)], F.lit(len(most)))
    named = chosen.select(key, "digest", "size", classed.alias("k"))
    found = sorted(r.k for r in named.select("k").distinct().collect())
    bounds = [-1, *most, None]
    for k in found or [0]:
        low, high = bounds[k], bounds[k + 1]
        size = F.octet_length("payload")
        mine = own.filter((size > low) & (size <= high) if high is not None else size > low)
        payloads = mine.dropDuplicates(["key"]).join(named.filter(F.col("k") == k), "key")
        records_each = FILE_PAYLOADS[k][1] if k < len(FILE_PAYLOADS) else 1
        payloads.select(F.concat(block, F.lit(_END), F.col("payload")).alias("value")).write.mode("append").options(
            **options, maxRecordsPerFile=records_each
        ).text(f"{folder}/payloads")


def parsed(content: bytes, bodies: bool) -> Iterator[tuple[bytes, bytes]]:
    """(header block, payload) of each record of a WARC file; without bodies, of header blocks."""
    raw, at, end = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0, _END.encode()
    while at < len(raw):
        stop = raw.index(end, at)
        head, at = raw[at:stop], stop + 4
        body = b""
        if bodies:
            size = int(field(head, b"Content-Length"))
            body, at = raw[at : at + size], at + size
            if raw[at : at + 4] != end:
                raise ValueError("a record does not end where its Content-Length says")
            at += 4
        yield head, body


def field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, found, value = line.partition(b": ")
        if found and key == name:
            return value
    return None


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, digest, header (exact bytes)."""

    def number(value: bytes | None) -> int | None:
        text = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, 1):
            for content in piece.column("content").to_pylist():
                heads = [h for h, _ in parsed(content, False)]
                yield pa.RecordBatch.from_pydict({
                    "page_id": pa.array([number(field(h, b"WARC-Record-ID")) for h in heads], pa.int64()),
                    "record_type": pa.array([field(h, b"WARC-Type").decode() for h in heads], pa.string()),
                    "refers_to": pa.array([number(field(h, b"WARC-Refers-To")) for h in heads], pa.int64()),
                    "digest": pa.array(
                        [field(h, b"WARC-Payload-Digest").decode().partition(":")[2] for h in heads], pa.string()
                    ),
                    "header": pa.array(heads, pa.binary()),
                })

    return _files(spark, f"{folder}/headers").mapInArrow(
        run, "page_id bigint, record_type string, refers_to bigint, digest string, header binary"
    )


def _payloads(spark: SparkSession, folder: str, with_bytes: bool) -> DataFrame:
    """digest, own_digest and size (of the bytes that are there), and the bytes if asked for."""
    schema = "digest string, own_digest string, size bigint" + ", payload binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, 1):
            for content in piece.column("content").to_pylist():
                both = list(parsed(content, True))
                out = {
                    "digest": pa.array(
                        [field(h, b"WARC-Payload-Digest").decode().partition(":")[2] for h, _ in both], pa.string()
                    ),
                    "own_digest": pa.array([hashlib.sha256(b).hexdigest() for _, b in both], pa.string()),
                    "size": pa.array([len(b) for _, b in both], pa.int64()),
                }
                if with_bytes:
                    out["payload"] = pa.array([b for _, b in both], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return _files(spark, f"{folder}/payloads").mapInArrow(run, schema)


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, header, payload: each record as it was, revisits with the
    payload they refer to. A payload is joined to as many records as share it."""
    return _headers(spark, folder).join(_payloads(spark, folder, True), "digest").select(
        "page_id", "record_type", "refers_to", "header", "payload"
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read from the files:
    size and digest are those of the stored bytes, worked out once for each payload."""
    # written first: a payload that very many records share can then be dealt out by the join
    stored = settle(_payloads(spark, folder, False))
    return settle(_headers(spark, folder).drop("header")).join(stored, "digest").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"),
        "record_type", "refers_to",
    )
