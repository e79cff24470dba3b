"""Streaming intake into a ledger: shared files become records, refused ones go to a sink of their own.

A batch is taken in twice without harm. Refusals are written to a folder named by the batch, which a second run replaces; records are
merged under the batch's name, which the ledger's log holds, so a second run changes nothing. If a job dies between the two, or
before the stream notes the batch as done, the stream hands it in again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.classify import select_kind
from ..operators.ledger import Ledger
from ..plans import lifecycle

#: A shared file: its share, its place in it, and what was extracted from it.
SHARED = "share string, place int, name string, text string, payload string, arrived timestamp"


def first_files(files: DataFrame) -> DataFrame:
    """One file a share: the first by place, then by name and text; the others of a share are not looked at. Null shares are left out."""
    rest = [c for c in files.columns if c != "share"]
    order = F.struct("place", "name", F.sha2(F.coalesce("text", F.lit("")), 256))
    return files.where("share IS NOT NULL").groupBy("share").agg(F.min_by(F.struct(*rest), order).alias("f")).select("share", "f.*")


def judged(files: DataFrame) -> DataFrame:
    """The first file of each share with ``kind``, and ``refused``: why it is not taken, or null."""
    known = select_kind(first_files(files).withColumnRenamed("share", "doc_id")).withColumnRenamed("doc_id", "share")
    blank = (F.coalesce(F.trim("text"), F.lit("")) == "") & (F.coalesce("payload", F.lit("")) == "")
    return known.withColumn("refused", F.when(blank, "empty").when(F.col("kind").isNull(), "unknown-kind")).withColumn("kind", F.when(F.col("refused").isNull(), F.col("kind")))


def records_of(files: DataFrame, now: int) -> DataFrame:
    """Rows of the ledger's schema of files that are taken."""
    docs = files.select(F.col("share").alias("doc_id"), "text", "payload", F.col("arrived").cast("date").alias("reference"))
    made = lifecycle.records(docs).select("id", "kind", F.col("fields"), "departs_at")
    return made.select("id", "kind", "fields", "departs_at", F.lit(now).cast("long").alias("added_at"), F.lit(None).cast("long").alias("updated_at"), F.lit("share").alias("source"), F.lit(False).alias("archived"))


def take_in(files: DataFrame, batch: int, ledger: Ledger, rejects: str, now: int, name: str = "share") -> int:
    """One batch of files into the ledger and the rejects' folder; the ledger's version after it."""
    seen = judged(files)
    seen.where("refused IS NOT NULL").select("share", "name", "refused", "arrived").write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
    fresh = records_of(seen.where("refused IS NULL").drop("kind", "refused"), now)
    columns = [f.name for f in StructType.fromDDL(ledger.schema)]
    return ledger.put(fresh.select(*columns), now, batch=f"{name}:{batch}")


def start(files: DataFrame, ledger: Ledger, rejects: str, checkpoint: str, now: int, name: str = "share") -> StreamingQuery:
    """Everything that has arrived, taken in batch by batch; run again for what arrives later."""
    return files.writeStream.foreachBatch(lambda df, batch: take_in(df, batch, ledger, rejects, now, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
