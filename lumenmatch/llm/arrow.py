"""Helpers shared by the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its values; a null is an empty value."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer value has a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


def map_batches(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch], Iterable[dict]]) -> DataFrame:
    """Applies ``work`` to every Arrow batch; it yields dicts of columns of the given schema."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays(
                        [columns[f.name] if isinstance(columns[f.name], pa.Array) and columns[f.name].type == f.type else pa.array(columns[f.name], f.type) for f in target],
                        schema=target,
                    )

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, names: Iterable[str], added: str) -> T.StructType:
    """Schema of some columns of ``df``, kept as they are, and of added ones given as DDL."""
    kept = [T.StructField(n, df.schema[n].dataType, True) for n in names]
    return T.StructType(kept + T.StructType.fromDDL(added).fields)
