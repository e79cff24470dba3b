"""The corpus pipeline over ``documents``, one operator of wayfare.llm a stage.

1. quality: documents that importance resampling rejects go.
2. dedup: one document, the least doc_id, of each near-duplicate group stays.
3. decontaminate: documents with a benchmark window go.
4. mix: each document is repeated as often as the source schedule takes it, at most twice.
5. tokens: ids in bit planes, written and read back; one row a document.

SQL cannot express the hashed models and noise of the first stage, so there is no ORACLE_SQL; the tests
hold every stage against a brute-force version.

Nulls, empty texts, ties and repeated rows are those of each operator: a text that is null or blank has weight 0
in quality, is no copy, holds no window, and is in no mix; repeated rows of one doc_id stay or go together. Empty
tables give empty tables, and all columns of documents, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.base import settle, small_side, stash
from wayfare.llm.bitplanes import round_trip
from wayfare.llm.decontaminate import clean_documents
from wayfare.llm.mixing import mixed
from wayfare.llm.near_dedup import near_duplicates
from wayfare.llm.quality import select_documents
from wayfare.llm.tokenizer_files import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes without the ids of which no row is kept; rows of one id are one document."""
    kept = F.max("kept").alias("kept")
    gone = settle(lambda: near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone_id")).agg(kept).where("not kept").select("_gone_id"), "gone")
    gone = small_side(gone, gone.count())
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats a document taken / size times: a fraction is one more copy with that probability, by a hash of doc_id.

    So a source's words come near its target, and what is taken by a part is kept as often as that part says.
    Rows of one doc_id are repeated alike; documents without words are in no mix.
    """
    share = F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11) / F.lit(float(1 << 53))
    times = settle(lambda: mixed(docs).groupBy("doc_id").agg(share.alias("_share")).select(F.col("doc_id").alias("_mixed_id"), F.least(F.floor(F.col("_share") + chance), F.lit(2)).cast("int").alias("_times")).where("_times > 0"), "times")
    times, copy = small_side(times, times.count()), "_copy"
    while copy in docs.columns:
        copy += "_"
    out = docs.join(times, docs["doc_id"].eqNullSafe(times["_mixed_id"]))
    return out.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), times["_times"])).alias(copy)).drop(copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, BYTE_BPE)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
