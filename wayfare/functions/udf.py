"""Arrow UDFs that are made when they are used, so that modules import without a session."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


#: Rows of one task in steps that are long for each row.
ROWS_A_TASK = 100_000

#: Rows whose results a Python step holds as objects.
PART_ROWS = 500


def spread(table: DataFrame) -> DataFrame:
    """A scanned table, dealt over all cores and over tasks of about ``ROWS_A_TASK`` rows, if it has fewer splits.

    For steps that are long for each row: a split is so many bytes, which are millions of short rows. Tables with as many
    splits as that, as those of long texts, are left as they are, without a shuffle. Rows are counted from the files' footers.
    """
    parts = parts_of(table)
    return table.repartition(parts) if table.rdd.getNumPartitions() < parts else table


def parts_of(table: DataFrame, rows: int = 0) -> int:
    """Tasks for a scanned table: as many as cores at least, and of about ``rows`` or ``ROWS_A_TASK`` rows."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // (rows or ROWS_A_TASK)))


def values(array: pa.Array) -> list:
    """``array.to_pylist()``, column by column: lists of structs, as items are, are not made value by value. A map is its pairs."""
    kind = array.type
    if pa.types.is_list(kind):
        inner, sizes, at, out = values(array.flatten()), pc.list_value_length(array).to_pylist(), 0, []
        for n in sizes:
            out.append(None if n is None else inner[at : at + n])
            at += n or 0
        return out
    if pa.types.is_map(kind):
        at, pairs = array.offsets.to_pylist(), list(zip(values(array.keys), values(array.items), strict=True))
        return [pairs[i:j] if ok else None for i, j, ok in zip(at, at[1:], array.is_valid().to_pylist(), strict=False)]
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        if not names or len(set(names)) < len(names):
            return array.to_pylist()
        rows = [dict(zip(names, row)) for row in zip(*map(values, array.flatten()))]  # noqa: B905
        return [r if ok else None for r, ok in zip(rows, array.is_valid().to_pylist(), strict=True)] if array.null_count else rows
    if (pa.types.is_integer(kind) or pa.types.is_float64(kind)) and not array.null_count:
        return array.to_numpy().tolist()
    if pa.types.is_string(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def each_row(fn: Callable, schema: str, columns) -> Column:
    """A Column of a plain function of one row's values, run on Arrow batches without going through pandas."""
    kind = to_arrow_type(DataType.fromDDL(schema), prefers_large_types=False)

    def run(*given: pa.Array) -> pa.Array:
        # a part at a time, so that few objects live at once
        rows = zip(*map(values, given), strict=True)
        return pa.concat_arrays([pa.array([fn(*row) for row in part], kind) for part in itertools.batched(rows, PART_ROWS)] or [pa.nulls(0, kind)])

    return F.arrow_udf(run, schema)(*columns)


def on_arrow(schema: str):
    """Turn a function of one row's values into one of Columns with a return type."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(*columns):
            return each_row(fn, schema, columns)

        return call

    return wrap
