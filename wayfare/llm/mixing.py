"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a fixed shuffled order and cut, as one stream of words, into blocks of
equal size. Slot ``t`` of the schedule has the golden-ratio point ``frac((t + 1) * 0.618...)``, which is
mapped through the cumulative weights to a source; the r-th slot of a source takes its block ``r mod
blocks``. So at every point of the schedule each source has had close to its share, and at the end its
number of slots is within a few of the target.

The number of slots is bounded (``slots`` plus a floor for each source), whatever the size of the corpus:
blocks grow instead. Positions in a stream come from sums in two levels, so that a source of any share of
the rows is spread over all tasks. Sources are assumed to be at most ``MAX_SOURCES``; their totals are
the only thing that the driver gathers.

A null text has size 0; documents of size 0 take nothing. Repeated rows are documents of their own, in
order of (doc_id, size); null doc_ids are allowed, and a null source is one of its own. Ties in the shuffled
order go by doc_id and size. An empty table gives an empty one. Only doc_id, text and source are read, so other
columns may have any name. More than ``MAX_SOURCES`` sources are an error, not a cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stash

GOLDEN = (math.sqrt(5) - 1) / 2
#: Blocks of all sources together, and of each source at least.
SLOTS, LEAST_BLOCKS = 1 << 16, 256
MAX_SOURCES = 100_000
#: Parts of a stream whose sums are carried over, at least, and rows of a part on average, at most.
PARTS, PART_ROWS = 1024, 1 << 16


def targets(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is shared again by weight."""
    out, free, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def plan(sources: list[tuple[str | None, int]], weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, slots: int = SLOTS, least: int = LEAST_BLOCKS) -> list[dict]:
    """One entry a source, by code point with null last: target, blocks, and its range [low, high) of the unit interval."""
    ordered = sorted(sources, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [s for _, s in ordered]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(ordered))], share * sum(sizes), cap)
    total = sum(sizes)
    out = []
    for k, ((source, size), goal) in enumerate(zip(ordered, goals, strict=True)):
        blocks = max(least, math.ceil(slots * size / total)) if size else 0
        out.append({"k": k, "source": source, "source_size": size, "target": goal, "blocks": blocks, "slots": blocks * goal / size if size else 0.0})
    n = sum(x["slots"] for x in out)
    at = 0.0
    for x in out:
        x["low"] = at / n if n else 0.0
        at += x["slots"]
        x["high"] = at / n if n else 0.0
    return out


def schedule(spark, entries: list[dict], cap: float = 2.0) -> DataFrame:
    """(slot, k, rank, block): the source of every slot, its rank among that source's, and the block it takes."""
    n = round(sum(x["slots"] for x in entries))
    used = [x for x in entries if x["slots"] > 0]
    if not n or not used:
        return spark.createDataFrame([], "slot long, k int, rank long, block long")
    bounds = np.array([x["high"] for x in used[:-1]])
    ks, blocks = np.array([x["k"] for x in used], np.int32), np.array([x["blocks"] for x in used], np.int64)

    def drawn(batches):
        for batch in batches:
            t = batch.column(0).to_numpy()
            point = (t + 1) * GOLDEN
            i = np.searchsorted(bounds, point - np.floor(point), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ks[i]), pa.array(blocks[i])], ["slot", "k", "blocks"])

    slot = spark.range(n).mapInArrow(drawn, "slot long, k int, blocks long").withColumn("part", F.expr(f"slot div {max(1, math.ceil(n / 64))}"))
    before = slot.groupBy("k", "part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("k", "part", "base")
    ranked = slot.join(before, ["k", "part"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("k", "part").orderBy("slot")) - 1)
    return ranked.where(F.col("rank") < cap * F.col("blocks")).select("slot", "k", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def word_count(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 8, slots: int = SLOTS, size=None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of (doc_id, text, source)."""
    spark = docs.sparkSession
    sized = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size")), "sizes")
    totals = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    entries = plan(totals, weights, share, cap, slots)
    known = spark.createDataFrame([(x["k"], x["source"], x["source_size"], float(x["target"]), x["blocks"]) for x in entries], "k int, name string, source_size long, target double, blocks long")
    parts = max(PARTS, 1 << (sized.count() // PART_ROWS).bit_length())
    # the shuffled order of a stream: parts by hash, then the hash, then what tells rows apart
    mixed_key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).withColumn("h", mixed_key).withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(parts)).cast("int"))
    before = rows.groupBy("k", "part").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("k", "part", "base")
    inner = Window.partitionBy("k", "part").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, ["k", "part"]).withColumn("start", F.col("base") + F.col("within")).withColumn("stop", F.col("start") + F.col("size"))
    placed = stash(placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "size", "source", "source_size", "target", "k", "blocks", "start", "stop"), "placed")
    # pieces: block b of a stream is [b * source_size div blocks, (b + 1) * source_size div blocks)
    first = "((start + 1) * blocks - 1) div source_size"
    last = "(stop * blocks - 1) div source_size"
    pieces = placed.where("size > 0").select("row", "k", "start", "stop", "source_size", "blocks", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    part = pieces.select("row", "k", "block", F.expr("least(stop, ((block + 1) * source_size) div blocks) - greatest(start, (block * source_size) div blocks)").alias("words"))
    times = schedule(spark, entries, cap).groupBy("k", "block").agg(F.count("*").alias("times"))
    took = part.join(times, ["k", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(took, "row", "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
