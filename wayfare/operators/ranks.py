"""Ranks and islands within groups of any size: a group that is too large for one task is worked on by several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folders import shared_folder

#: Rows of a group that one task sorts; larger groups are dealt over several.
LARGE = 1_000_000


def by_size(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to ``LARGE`` rows, and those of larger groups, or None if there are none.

    This counts the groups, in a pass of its own over the keys. The driver sees the keys of large groups, one for each ``LARGE`` rows at most.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).drop("_n")
    found = sizes.collect()
    if not found:
        return df, None
    large = F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema).select(*(F.col(k).alias(f"_large_{k}") for k in keys)))
    on = [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    return df.join(large, on, "left_anti"), df.join(large, on, "left_semi")


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1, by ``order``, which must be total within a group.

    Rows are dealt by ranges of (keys, order) and written to the shared folder, so that their parts stay what they are; a place is
    the one within the part, plus the rows of the group in earlier parts. The sums that this takes are one row for each part and group in it.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "ranks")
    df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col("d._part") == F.col("o._part"), *(F.col(f"d.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys)]
    joined = dealt.alias("d").join(offsets.alias("o"), on).select("d.*", "_before")
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return joined.select(*df.columns, (place + F.col("_before")).cast("long").alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, gap: str, name: str = "island") -> DataFrame:
    """df with the number, from 0, of the island that each row is in: a new one begins where ``value`` is more than ``gap`` above that of the row before.

    ``order`` must be total within a group and ``value`` not null. Groups that a task can sort are shuffled once, by their keys; larger ones are dealt.
    """
    small, large = by_size(df, keys)
    out = islands_sorted(small, keys, order, value, gap, name)
    return out if large is None else out.unionByName(islands_dealt(large, keys, order, value, gap, name))


def islands_sorted(df: DataFrame, keys: list[str], order: list[str], value: str, gap: str, name: str = "island") -> DataFrame:
    """``islands`` of groups that a task can sort."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(rows) > F.col(gap)).cast("int"), F.lit(0)))
    return flagged.select(*df.columns, F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias(name))


def islands_dealt(df: DataFrame, keys: list[str], order: list[str], value: str, gap: str, name: str = "island") -> DataFrame:
    """``islands`` of groups of any size. As in ``rank_within``, rows are dealt by ranges; the last value and the number of beginnings of each part
    and group are carried over to the next part.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "islands")
    df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    same = lambda a, b: [F.col(f"{a}._part") == F.col(f"{b}._part"), *(F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys)]
    parts, rows = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy("_part", *keys).orderBy(*order)
    ends = dealt.groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_last")).withColumn("_before", F.lag("_last").over(parts)).drop("_last")
    joined = dealt.alias("d").join(ends.alias("e"), same("d", "e")).select("d.*", "_before")
    previous = F.coalesce(F.lag(value).over(rows), F.col("_before"))
    flagged = joined.withColumn("_new", F.coalesce((F.col(value) - previous > F.col(gap)).cast("int"), F.lit(0))).drop("_before")
    counts = flagged.groupBy("_part", *keys).agg(F.sum("_new").alias("_n"))
    offsets = counts.withColumn("_sum", F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    whole = flagged.alias("f").join(offsets.alias("o"), same("f", "o")).select("f.*", "_sum")
    return whole.select(*df.columns, (F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum")).cast("long").alias(name))
