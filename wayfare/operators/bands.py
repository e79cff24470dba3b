"""Interval joins: rows whose extents on a line overlap, as an equality join over bins.

Each interval [low, high) is listed in every bin that it touches, and rows meet in bins; a pair that shares several bins is
kept in the first of them only. So no side is compared with all of the other, and the join shuffles by key
and bin, or broadcasts what Spark knows to be small. An interval with a null end, or one that does not end after it begins, meets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import by_size


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """How much two intervals share; 0 or less if they do not."""
    return F.least(high_a, high_b) - F.greatest(low_a, low_b)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, bin: float) -> DataFrame:
    """All pairs of equal keys whose intervals overlap, with ``overlap``.

    Columns of ``right`` other than the keys come out as structs ``right``, those of ``left`` as ``left``. ``bin`` should be about the usual
    width: a wider interval is listed more often, a smaller bin makes fewer chance meetings.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(bin)).cast("long")
    last = F.greatest(at(low), (F.ceil(F.col(high) / F.lit(bin)) - 1).cast("long"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        own = df.where(F.col(high) > F.col(low))
        rest = F.struct(*(F.col(c) for c in df.columns if c not in keys)).alias(name)
        return own.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), rest, F.explode(F.sequence(at(low), last)).alias("_bin"), at(low).alias(f"_{name}_first"))

    on = [f"_k{i}" for i in range(len(keys))] + ["_bin"]
    met = listed(left, "left").join(listed(right, "right"), on).where(F.col("_bin") == F.greatest("_left_first", "_right_first"))
    shared = overlap(F.col("left")[low], F.col("left")[high], F.col("right")[low], F.col("right")[high])
    return met.where(shared > 0).select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "left", "right", shared.alias("overlap"))


def cells_by_header(cells: DataFrame, headers: DataFrame, page: str = "page_id", row: str = "row_id", share: float = 0.35, bin: float = 60.0) -> DataFrame:
    """The cell of each row that stands under each header: (page, row, header, text).

    cells: page, row, x, width, text; headers: page, x, width, header. A cell is under a header if they share more than ``share`` of the
    narrower one. Of several cells the one that shares most is taken, then the one further left, then by text.

    Cells and headers of a page are shuffled once, by page, and meet there in bins; pages of more than ``ranks.LARGE`` of them are dealt over
    several tasks by bins, as in ``band_join``.
    """
    end = F.col("x") + F.col("width")
    wide = lambda df, *columns: df.where((end > F.col("x")) & F.col(page).isNotNull()).select(page, *columns, "x", "width")
    cells, headers = wide(cells, row, "text"), wide(headers, "header")
    both = cells.withColumn("_head", F.lit(False)).unionByName(headers.withColumn("_head", F.lit(True)), allowMissingColumns=True)
    small, large = by_size(both, [page])
    met = _met_in_pages(small, page, row, bin)
    if large is not None:
        large = large.withColumn("_end", end)
        pairs = band_join(large.where(~F.col("_head")).drop("header", "_head"), large.where("_head").drop(row, "text", "_head"), [page], "x", "_end", bin)
        met = met.unionByName(pairs.select(page, F.col("left")[row].alias(row), *(F.col("left")[c].alias(c) for c in ("text", "x", "width")), F.col("right")["header"].alias("header"), F.col("right")["width"].alias("_wide"), "overlap"))
    enough = F.col("overlap") > F.lit(share) * F.least("width", "_wide")
    return met.where(enough).groupBy(page, row, "header").agg(F.max_by("text", F.struct("overlap", F.negative("x"), "text")).alias("text"))


def _met_in_pages(both: DataFrame, page: str, row: str, bin: float) -> DataFrame:
    """Pairs of cells and headers that overlap: the headers of a page's bin are listed beside each of its cells."""
    at = lambda c: F.floor(c / F.lit(bin)).cast("long")
    last = F.greatest(at(F.col("x")), (F.ceil(F.col("_end") / F.lit(bin)) - 1).cast("long"))
    binned = both.repartition(page).withColumn("_end", F.col("x") + F.col("width")).withColumn("_bin", F.explode(F.sequence(at(F.col("x")), last)))
    heads = F.collect_list(F.when(F.col("_head"), F.struct("header", F.col("x").alias("low"), F.col("_end").alias("high"), "width"))).over(Window.partitionBy(page, "_bin"))
    beside = binned.withColumn("_heads", heads).where(~F.col("_head")).drop("header").withColumn("_h", F.explode("_heads")).drop("_heads")
    shared = overlap(F.col("x"), F.col("_end"), F.col("_h.low"), F.col("_h.high"))
    first = F.col("_bin") == F.greatest(at(F.col("x")), at(F.col("_h.low")))
    return beside.where(first & (shared > 0)).select(page, row, "text", "x", "width", F.col("_h.header").alias("header"), F.col("_h.width").alias("_wide"), shared.alias("overlap"))
