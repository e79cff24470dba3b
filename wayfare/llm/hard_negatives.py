"""Hard-negative mining by a Voronoi-partitioned, distributed kNN join of anchors with all rows.

Components become integers, floor(scale * x), and a score is an inner product. A row x with |x| <= M stands for
(x, sqrt(M^2 - |x|^2)) and an anchor q for (q, 0), so that |q - x|^2 = |q|^2 + M^2 - 2 q.x: higher scores are nearer, and
what the triangle inequality says about distances to pivots bounds scores.

Every row is assigned to its nearest pivot. Anchors of one or more neighbouring cells make a group of about
``GROUP`` anchors. A join is done twice, with the same code:

* positives: of each anchor the first rows of its label
* negatives: for each anchor and positive, the first rows of other labels within a window of scores

and in two steps. At home, a group meets the rows of its own cells. What that finds gives each anchor a least score
that still matters, so each group has for every pivot an interval of distances in which a row must lie; each other row
goes to the groups whose intervals it meets for all pivots, and to no others. There a local exact join takes
the rest. Rows of one group are dealt over blocks of about ``BLOCK`` by a hash of their id, so a cell or
group of any size is spread over tasks; each block gives back a few rows for each anchor and window, and a window
function takes the first of those. No row that could be in the result is left out, whatever the pivots are: they are a
bounded sample, ``pivots`` rows by a hash of their id, and only decide how much is pruned.

Rows with a null id, label or vector, or a null or non-finite component take no part; nor do those whose integer vector
has a squared length of 2^56 or more, for which scores in longs are not defined. Shorter vectors count as padded with zeros.
Of rows with one id, the one of least label and vector takes part. Ties of scores go by the smaller id. An anchor without
positives, or none of whose windows holds a row, gives no rows; nor does a positive with a negative score, whose window
is empty. An empty table gives an empty one. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stash
from .vectors import integer_rows, matrix, padded, products, squared

#: Anchors of a group, about; groups at most (beyond, groups are larger); rows of a block, about.
GROUP, GROUPS, BLOCK = 512, 4096, 8192
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Space:
    """The pivots in the space of norm-augmented vectors."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.m2 = pivots.astype(np.float64), float(longest)
        self.last = self._last(self.pivots)
        #: more than rounding can change a distance by
        self.slack = 1e-6 * max(1.0, np.sqrt(self.m2))

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(1)))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        x = v.astype(np.float64)
        return np.sqrt(np.maximum(0.0, 2 * self.m2 - 2 * (x @ self.pivots.T + self._last(x)[:, None] * self.last[None, :])))

    def of_anchors(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of anchors to all pivots, and |q|^2 + M^2."""
        x = v.astype(np.float64)
        own = (x * x).sum(1) + self.m2
        return np.sqrt(np.maximum(0.0, own[:, None] - 2 * (x @ self.pivots.T))), own


@dataclass
class Groups:
    """Cells to anchor groups: those of cell c are first[c] ... first[c] + parts[c] - 1."""

    first: list[int]
    parts: list[int]
    n: int

    def homes(self, cell: int) -> range:
        return range(self.first[cell], self.first[cell] + self.parts[cell])


def group_cells(space: Space, anchors: list[int], size: int) -> Groups:
    """Groups of about ``size`` anchors: large cells are divided, small ones go with the next unused nearest one."""
    p = np.hstack([space.pivots, space.last[:, None]])
    far = ((p[:, None, :] - p[None, :, :]) ** 2).sum(2)
    first, parts, n, filled, at, free = [0] * len(p), [0] * len(p), 0, 0, 0, set(range(len(p)))
    while free:
        free.discard(at)
        if anchors[at] >= size:
            first[at], parts[at] = n + (filled > 0), -(-anchors[at] // size)
            n, filled = first[at] + parts[at], 0
        elif anchors[at]:
            if filled and filled + anchors[at] > size:
                n, filled = n + 1, 0
            first[at], parts[at], filled = n, 1, filled + anchors[at]
        if free:
            at = min(free, key=lambda c: (far[at, c], c))
    return Groups(first, parts, n + (filled > 0))


def local_join(left: pa.Table, right: pa.Table, dim: int, k: int, same: bool) -> pa.Table:
    """For each anchor and window of ``left``, the first k rows of ``right`` by score, then by id."""
    out: tuple[list, ...] = ([], [], [], [])
    ids, labels = np.asarray(right["id"]), np.asarray(right["label"])
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], matrix(right["v"], dim)[order]
    anchors, own, queries = np.asarray(left["id"]), np.asarray(left["label"]), matrix(left["v"], dim)
    windows = left["windows"].to_pylist()
    for at in range(0, len(anchors), 64):
        scores = products(queries[at : at + 64], rows)
        for i, score in enumerate(scores, at):
            fits = ((labels == own[i]) == same) & (ids != anchors[i])
            for w in windows[i]:
                good = np.flatnonzero(fits & (score >= w["low"]) & (score <= w["high"]))
                s = score[good]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    good, s = good[s >= least], s[s >= least]
                best = np.argsort(-s, kind="stable")[:k]
                for column, x in zip(out, (np.full(len(best), anchors[i]), np.full(len(best), w["key"]), ids[good[best]], s[best]), strict=True):
                    column.append(x)
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["anchor", "key", "other", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


class Join:
    """rows: (id, label, cell, v), stashed; anchors of a join: (id, label, group, v, windows)."""

    def __init__(self, rows: DataFrame, space: Space, groups: Groups, dim: int, block: int):
        self.rows, self.space, self.groups, self.dim, self.block = rows, space, groups, dim, block

    def _met(self, anchors: DataFrame, goes, k: int, same: bool) -> DataFrame:
        """Local joins of each group with the rows that ``goes`` (cells, vectors -> rows by groups) sends to it."""
        spark, dim, block, n = anchors.sparkSession, self.dim, self.block, self.groups.n

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, np.int64)
            for b in batches:
                for g, at in goes(np.asarray(b.column(0)), matrix(b.column(1), dim)):
                    total[g] += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["group", "n"])

        counted = {r["group"]: r["n"] for r in self.rows.select("cell", "v").mapInArrow(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
        blocks = {g: -(-c // block) for g, c in counted.items()}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part = np.asarray(b.column(4)).astype(np.uint64)
                for g, at in goes(np.asarray(b.column(2)), matrix(b.column(3), dim)):
                    if len(at):
                        own = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array(np.full(len(at), g, np.int32)), pa.array((part[at] % np.uint64(blocks[g])).astype(np.int32))], ["id", "label", "v", "group", "block"])

        sent = self.rows.select("id", "label", "cell", "v", F.xxhash64("id").alias("part")).mapInArrow(deal, "id long, label long, v array<long>, group int, block int")
        # one row a group, GROUPS at most
        each = spark.createDataFrame([(g, c) for g, c in blocks.items()], "group int, _blocks int")
        asked = anchors.join(F.broadcast(each), "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("id", "label", "v", "windows", "group", "block")
        return asked.groupBy("group", "block").cogroup(sent.groupBy("group", "block")).applyInArrow(lambda a, b: local_join(a, b, dim, k, same), "anchor long, key long, other long, score long")

    def _bounds(self, anchors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For each group and pivot, the distances between which a row must lie to be in one of the windows."""
        space, dim = self.space, self.dim

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                far, own = space.of_anchors(matrix(b.column(1), dim))
                low, high = (np.asarray(b.column(i)).astype(np.float64) for i in (2, 3))
                most, least = np.sqrt(np.maximum(0.0, own - 2 * low)), np.sqrt(np.maximum(0.0, own - 2 * high))
                lo = np.maximum(far - most[:, None], least[:, None] - far)
                hi = far + most[:, None]
                group = np.repeat(np.asarray(b.column(0)), far.shape[1])
                pivot = np.tile(np.arange(far.shape[1], dtype=np.int32), len(far))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(pivot), pa.array(lo.ravel()), pa.array(hi.ravel())], ["group", "pivot", "lo", "hi"])

        least, most = F.array_min(F.transform("windows", lambda w: w["low"])), F.array_max(F.transform("windows", lambda w: w["high"]))
        each = anchors.select("group", "v", least.alias("least"), most.alias("most")).mapInArrow(bound, "group int, pivot int, lo double, hi double")
        lo, hi = np.full((self.groups.n, len(space.pivots)), np.inf), np.full((self.groups.n, len(space.pivots)), -np.inf)
        for r in each.groupBy("group", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # GROUPS x pivots at most
            lo[r["group"], r["pivot"]], hi[r["group"], r["pivot"]] = r["lo"] - space.slack, r["hi"] + space.slack
        return lo, hi

    def first(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, key, other, score, place): the first k rows within each window of each anchor."""
        groups, space = self.groups, self.space

        def home(cells: np.ndarray, v: np.ndarray):
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                yield from ((g, at) for g in groups.homes(c))

        near = stash(_first(self._met(anchors, home, k, same), k).drop("place"), "near")
        # a window that is full at home needs nothing below its last score, but equal scores with smaller ids
        full = near.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        by = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("key", "least"))).alias("least"))
        raised = F.transform("windows", lambda w: F.struct(w["key"].alias("key"), F.greatest(w["low"], F.coalesce(F.try_element_at("least", w["key"]), w["low"])).alias("low"), w["high"].alias("high")))
        tight = stash(anchors.join(by, anchors["id"] == by["anchor"], "left").select("id", "label", "group", "v", raised.alias("windows")), "tight")
        lo, hi = self._bounds(tight)

        def away(cells: np.ndarray, v: np.ndarray):
            far = space.of_rows(v)
            for g in range(groups.n):
                own = [c for c in range(len(groups.first)) if g in groups.homes(c)]
                yield g, np.flatnonzero(~np.isin(cells, own) & (far >= lo[g]).all(1) & (far <= hi[g]).all(1))

        return _first(near.unionByName(self._met(tight, away, k, same)), k)


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int = 64,
    id: str = "vec_id", vector: str = "embedding", label: str = "label", group: int = GROUP, block: int = BLOCK,
) -> DataFrame:
    """Negatives of the rows of df where ``anchors`` (a condition on ``id`` and ``label``) holds.

    For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows of other labels
    with low * positive score <= 100 * score <= high * positive score; low and high are from 0 to 100. Columns as in RESULT.
    """
    spark = df.sparkSession
    plain = integer_rows(df, vector, scale, {"id": F.col(id).cast("long"), "label": F.col(label).cast("long")}).where("id IS NOT NULL AND label IS NOT NULL")
    whole = stash(plain.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")
    dim, longest, n = whole.agg(F.max(F.size("v")), F.max(squared(F.col("v"))), F.count_if(anchors)).first()
    if not dim or not n:
        return spark.createDataFrame([], RESULT)
    whole = whole.withColumn("v", padded(F.col("v"), dim))
    sample = np.array([r["v"] for r in whole.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], np.int64).reshape(-1, dim)
    space = Space(np.unique(sample, axis=0), longest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = space.of_rows(matrix(b.column(2), dim)).argmin(1).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    rows = stash(whole.select("id", "label", "v").mapInArrow(assign, "id long, label long, v array<long>, cell int"), "cells")
    chosen = rows.where(anchors)
    cells = {r["cell"]: r["n"] for r in chosen.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    groups = group_cells(space, [cells.get(c, 0) for c in range(len(space.pivots))], max(group, -(-n // GROUPS)))
    join = Join(rows, space, groups, dim, block)

    first, parts = (F.array(*(F.lit(x) for x in xs)) for xs in (groups.first, groups.parts))
    at = F.col("cell") + 1
    own = (F.element_at(first, at) + F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(parts, at))).cast("int")
    asked = chosen.select("id", "label", own.alias("group"), "v")
    whole_line = F.array(F.struct(F.col("id").alias("key"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    liked = stash(join.first(asked.withColumn("windows", whole_line), positives, True), "positives")
    ranges = liked.where(F.col("score") >= 0).select("anchor", F.struct(F.col("other").alias("key"), F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high")).alias("w"))
    windows = ranges.groupBy("anchor").agg(F.collect_list("w").alias("windows"))
    against = stash(asked.join(windows, asked["id"] == windows["anchor"]).drop("anchor"), "windows")
    found = join.first(against, negatives, False)
    scores = liked.select("anchor", F.col("other").alias("key"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor", "key"]).select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
