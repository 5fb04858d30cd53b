"""Computations that depend on the order of the rows of a group, streamed over sorted partitions.

Rows are brought together by key and sorted by Spark, which spills; Python sees one row after the other and keeps only the
state of the group at hand, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

OUT_ROWS = 8192


def fold(rows: DataFrame, n_keys: int, order: list, fn: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fn(key, rows of the group in order) -> result rows, for each distinct value of the first n_keys columns of rows."""
    keys = rows.columns[:n_keys]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for key, group in groupby(stream, key=lambda t: t[:n_keys]):
            out.extend(fn(key, group))
            if len(out) >= OUT_ROWS:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
