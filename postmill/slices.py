"""Slices of Arrow batches, so that what Python makes of wide rows stays small."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Bytes of a slice of an Arrow batch: an operator may need some forty times that in a worker.
SLICE_BYTES = 4 << 20


def in_slices(
    batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most so many rows and bytes, in order, so that what Python makes
    of them stays small; a row that is larger by itself is a slice of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            waiting = [batch.slice(at, rows)]
            while waiting:
                piece = waiting.pop()
                if piece.num_rows > 1 and piece.nbytes > size:
                    half = piece.num_rows // 2
                    waiting += [piece.slice(half), piece.slice(0, half)]
                else:
                    yield piece


def by_slice(
    df: DataFrame, columns: list[str | Column], schema: str,
    job: Callable[[pa.RecordBatch], dict[str, object]], rows: int = 512,
) -> DataFrame:
    """`job` turns the named columns of a slice into columns of `schema`; no shuffle."""
    names = [f.name for f in _struct(schema)]
    kinds = [_arrow(f.dataType) for f in _struct(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_slices(batches, rows):
            made = job(piece)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v := made[n], pa.Array) else pa.array(v, k)
                 for n, k in zip(names, kinds, strict=True)], names,
            )

    return df.select(*columns).mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def each(values: pa.Array, fn: Callable[[object], object], kind: pa.DataType, rows: int = 64) -> pa.Array:
    """`fn` of each value, made slice by slice: only Arrow data is held of all of them."""
    batch = pa.RecordBatch.from_arrays([values], ["v"])
    made = [pa.array([fn(v) for v in p.column(0).to_pylist()], kind) for p in in_slices(iter([batch]), rows)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
