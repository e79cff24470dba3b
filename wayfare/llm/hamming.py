"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are 64-bit longs in ``segments`` equal parts. If two codes differ in fewer than ``segments * (r + 1)``
bits, some part differs in at most r bits. So a search that has looked up all values within radius r of the
query's parts has seen every code closer than ``segments * (r + 1)``; the radius grows until the k-th
verified distance is below that bound, or all radii are done.

Rows are searched in blocks: a task holds one block of at most ``BLOCK`` codes with its tables, and one
chunk of at most ``CHUNK`` queries, gives the block's k best for each query, and those are merged. With several
blocks, one is searched first, and its k-th distance bounds the radius in all others. Blocks are made by hash,
so equal codes of any number are spread. Ties go by the lower id. Rows with a null id or code are in no result;
repeated rows count each. Empty tables give an empty result. Only id and code are read, so other columns may
have any name. Elements of a vector beyond the bits of a code play no part in it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stash

BLOCK, CHUNK = 1 << 16, 1 << 12
_POP = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)
_masks: dict[tuple[int, int], np.ndarray] = {}


def sign_codes(vector: Column, bits: int = 64) -> Column:
    """A long whose bit i is set where element i is above 0; null for a null vector. Missing elements are 0."""
    bit = lambda i: F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    return F.when(vector.isNotNull(), out)


def distances(codes: np.ndarray, query: int) -> np.ndarray:
    x = (codes ^ np.uint64(query)).view(np.uint16).reshape(-1, 4)
    return _POP[x].sum(1, dtype=np.int64)


def ring(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    key = (width, radius)
    if key not in _masks:
        _masks[key] = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
    return _masks[key]


class Index:
    """Tables of one block: for each part, rows ordered by the part's value."""

    def __init__(self, codes: np.ndarray, segments: int = 4):
        self.codes, self.segments, self.width = codes, segments, 64 // segments
        self.tables = []
        for s in range(segments):
            value = self.part(codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.width))])))

    def part(self, codes, s: int):
        return ((codes >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def search(self, query: int, ids: np.ndarray, k: int, bound: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest at a distance of ``bound`` at most, by distance and id."""
        seen = np.zeros(len(self.codes), bool)
        rows, near = np.empty(0, np.int64), np.empty(0, np.int64)
        parts = [int(self.part(np.array([query], np.uint64), s)[0]) for s in range(self.segments)]
        for r in range(self.width + 1):
            fresh = []
            for s, (order, ends) in enumerate(self.tables):
                at = ring(self.width, r) ^ parts[s]
                lo, n = ends[at], ends[at + 1] - ends[at]
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    stop = np.cumsum(n)
                    fresh.append(order[np.arange(stop[-1]) + np.repeat(lo - (stop - n), n)])
            if fresh:
                new = np.unique(np.concatenate(fresh))
                new = new[~seen[new]]
                seen[new] = True
                rows, near = np.concatenate([rows, new]), np.concatenate([near, distances(self.codes[new], query)])
                if len(rows) > k:
                    best = np.lexsort((ids[rows], near))[:k]
                    rows, near = rows[best], near[best]
            if self.segments * (r + 1) > bound or (len(rows) >= k and near.max() < self.segments * (r + 1)):
                break
        rows, near = rows[near <= bound], near[near <= bound]
        best = np.lexsort((ids[rows], near))[:k]
        return rows[best], near[best]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest rows of (id, code) to each row of (id, code) in queries."""
    if 64 % segments or 64 // segments > 24:
        raise ValueError("segments must divide 64 and leave at most 24 bits each")
    n_rows, n_queries = codes.where("id is not null and code is not null").count(), queries.where("id is not null and code is not null").count()
    blocks, chunks = max(1, -(-n_rows // block)), max(1, -(-n_queries // chunk))
    dealt = lambda n: F.pmod(F.xxhash64("id", "code", F.lit(n)), F.lit(n)).cast("int")
    clean = lambda df: df.where("id is not null and code is not null").select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = clean(codes).withColumn("block", dealt(blocks)).withColumn("asks", F.lit(False)).withColumn("bound", F.lit(64))
    asks = clean(queries).withColumn("chunk", dealt(chunks)).withColumn("asks", F.lit(True)).withColumn("bound", F.lit(64))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, codes = table["id"].to_numpy(), table["code"].to_numpy().view(np.uint64)
        own, own_codes, bounds = ids[~asks], np.ascontiguousarray(codes[~asks]), table["bound"].to_numpy()[asks]
        found = {"query_id": [], "query_code": [], "id": [], "distance": []}
        if len(own):
            index = Index(own_codes, segments)
            for q, code, bound in zip(ids[asks], codes[asks], bounds, strict=True):
                at, near = index.search(int(code), own, k, int(bound))
                found["query_id"].append(np.full(len(at), q))
                found["query_code"].append(np.full(len(at), code).view(np.int64))
                found["id"].append(own[at])
                found["distance"].append(near)
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for n, v in found.items()})

    def searched(rows: DataFrame, asks: DataFrame) -> DataFrame:
        names = ["id", "code", "block", "chunk", "asks", "bound"]
        both = rows.withColumn("chunk", every(chunks)).select(*names).union(asks.select(*names))
        return both.groupBy("block", "chunk").applyInArrow(search, "query_id long, query_code long, id long, distance long")

    if blocks == 1:
        best = searched(rows, asks.withColumn("block", F.lit(0)))
    else:
        first = stash(searched(rows.where("block = 0"), asks.withColumn("block", F.lit(0))), "first")
        limits = first.groupBy("query_id", "query_code").agg(F.count("*").alias("n"), F.max("distance").cast("int").alias("kth")).where(F.col("n") >= k)
        met = (asks["id"] == limits["query_id"]) & (asks["code"] == limits["query_code"])
        bounded = asks.drop("bound").join(limits, met, "left").withColumn("bound", F.coalesce("kth", F.lit(64)))
        best = first.union(searched(rows.where("block > 0"), bounded.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")
