"""What the operators of this subpackage share: the shared folder, cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local, as in tests, a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        conf = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Rows of an Arrow batch: texts are held a few megabytes at a time, whatever the partition.
BATCH_ROWS = 1000


def texts_of(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded to BATCH_ROWS; for what goes through Python with its texts.

    Spark reads this setting when a query runs, so it has to stay lowered after the operator returned; one that
    is lower already is left alone, and no result depends on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/wayfare-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _open:
        _open[-1].append(path)
    return path


#: Paths that were made within each ``settle`` in progress.
_open: list[list[str]] = []


def settle(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stash what ``build`` gives, and delete the stashes that were made on the way, which it alone reads."""
    _open.append(own := [])
    try:
        df = build()
    finally:
        _open.pop()
    out = stash(df, name)
    for path in own:
        _delete(df.sparkSession, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts lineage, survives lost executors, and gives Spark the size of the result.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key-only table up to which it is broadcast; beyond, the join is left to shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its measured row count allows it; df must be a few columns of numbers."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Parts that the rows of one key are spread over where a key table is too large to broadcast.
SALT = 16


def beside(big: DataFrame, small: DataFrame, key: str, rows: int, by: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, ``rows`` in all, and only numbers or digests.

    A small side of a checked size is broadcast; beyond that each key's rows of ``big`` are dealt by ``by``
    over ``SALT`` parts, so that a key with a third of all rows is no one task's work.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return big.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(salted, [key, "_s"], how).drop("_s")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) long pairs; component is the least node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes. Nodes with many
    neighbours are never gathered: every step is a partial minimum, and a join that broadcasts the minima
    while they are few, or else deals each node's rows over ``SALT`` parts. Self-loops and repeats are
    allowed; nodes in no edge are not returned.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    was = state(now)
    while True:
        nodes = 2 * was[0]  # at most
        # large-star: the larger neighbours of u point to the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = beside(both, low, "u", nodes, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours point to the least of them
        low = least(large)
        small = beside(large, low, "u", nodes, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        now = stash(small, name)
        then = state(now)
        if then == was:
            break
        was = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
