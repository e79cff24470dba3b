"""Vector code compression: product quantisation with integer codebooks, learned by Lloyd rounds.

A vector's components become integers, floor(scale * x), and the vector is cut into equal consecutive parts. Each
part position has a codebook, which starts as that part of the vectors with the smallest ids. A round assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by
floor(sum / count) of its parts; an entry without parts stays.

Codebooks, parts x entries x width integers whatever the table, are broadcast. A task computes all distances of an
Arrow batch by norm expansion, |x|^2 - 2 x.c + |c|^2, in exact int64 matrix products, and takes the first least. It
adds up sums and counts by entry, and gives back at most one row for each entry and component; those are merged
by a grouped shuffle, so that an entry that has most of all parts is no one task's work.

Rows whose vector is null or has a null or non-finite component are dropped, as are those whose integer vector has a
squared length of 2^56 or more, which longs cannot hold. Shorter vectors count as padded with zeros to the longest one,
and that to a multiple of the number of parts. With fewer rows than entries the codebooks are shorter. Null ids come
after all others; of equal ids the lesser vector comes first; repeated rows are rows of their own. An empty table
gives an empty one and empty codebooks. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integer_rows, matrix, padded


@dataclass
class Codebooks:
    """entries[part, entry, position]: int64."""

    entries: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def text(self) -> str:
        """All components in decimal, by part, entry and position."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x, the first nearest entry and its squared distance; all int64."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _rows(df: DataFrame, scale: int, dim: int, vector: str, keep: dict) -> DataFrame:
    return integer_rows(df, vector, scale, keep).withColumn("v", padded(F.col("v"), dim))


def _parts(x: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    yield from (np.ascontiguousarray(p) for p in np.split(x, parts, axis=1))


def learn(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of all vectors of df. df is scanned ``rounds`` + 2 times."""
    spark = df.sparkSession
    plain = integer_rows(df, vector, scale, {"id": F.col(id)})
    longest = plain.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(1, -(-longest // parts)) * parts
    rows = _rows(df, scale, dim, vector, {"id": F.col(id)})
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    width = dim // parts
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(books))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                for p, x in enumerate(_parts(matrix(b.column(0), dim), parts)):
                    at, _ = nearest(x, books[p])
                    order = np.argsort(at, kind="stable")
                    used, start = np.unique(at[order], return_index=True)
                    if len(used):
                        sums[p, used] += np.add.reduceat(x[order], start, axis=0)
                        counts[p] += np.bincount(at, minlength=books.shape[1])
            part, entry = np.nonzero(counts)
            own = sums[part, entry]
            n = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part, width).astype(np.int32)), pa.array(np.repeat(entry, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), n)),
                pa.array(own.ravel()), pa.array(np.repeat(counts[part, entry], width)),
            ], ["part", "entry", "position", "total", "n"])

        sums = rows.select("v").mapInArrow(add, "part int, entry int, position int, total long, n long")
        merged = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in merged:
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
        shared.unpersist()
    return Codebooks(books, scale)


def encode(df: DataFrame, books: Codebooks, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, ``code`` (two hex digits a part) and ``error`` (squared distances over all parts)."""
    rows = _rows(df, books.scale, books.dim, vector, {"_id": F.col(id)} | {f"_k{i}": F.col(c) for i, c in enumerate(keep)})
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(books.entries))
    parts, dim, digits = books.entries.shape[0], books.dim, max(2, len(f"{max(books.entries.shape[1] - 1, 0):x}"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        hexes = np.array([f"{i:0{digits}x}" for i in range(entries.shape[1])])
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(b.num_columns - 1), dim)
            text, error = np.full(len(x), "", dtype=f"U{digits * parts}"), np.zeros(len(x), np.int64)
            for p, part in enumerate(_parts(x, parts)):
                at, far = nearest(part, entries[p])
                text, error = np.char.add(text, hexes[at]), error + far
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text.tolist(), pa.string()), pa.array(error)], [*b.schema.names[:-1], "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(code, ", ".join(f"{c} {t}" for c, t in types.items() if c != "v") + ", code string, error long")
    return out.select(F.col("_id").alias(id), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "code", "error")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with ``approximation``: the vector that its code stands for, as doubles."""
    digits = max(2, len(f"{max(books.entries.shape[1] - 1, 0):x}"))
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(books.entries))
    scale, parts = books.scale, books.entries.shape[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for b in batches:
            text = b.column(b.schema.get_field_index(code)).to_pylist()
            near = [None if t is None else np.concatenate([entries[p, int(t[digits * p : digits * (p + 1)], 16)] for p in range(parts)]) / scale for t in text]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.float64()))], [*b.schema.names, "approximation"])

    return codes.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", approximation array<double>")
