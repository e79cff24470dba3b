"""Quality selection by importance resampling.

Texts are split into runs of letters and digits and runs of other visible characters, A-Z lower-cased;
unigrams and bigrams of those runs are hashed into ``buckets``. Two generative models are bucket
frequencies: of the target, texts labelled as good, and of the raw corpus, all texts. A document's log
weight is the sum over its grams of log(target / raw), and Gumbel top-k on the log weights draws k
documents without replacement in proportion to their weights.

The raw model counts every document. The target model is fitted on at most ``fit_rows`` labelled rows,
those least by a hash of doc_id. Where k is not given, it is the number of documents whose weight is at
least the threshold that separates those labelled rows best.

The k-th key is found by radix selection: four passes that count keys by 16 bits each, so nothing is
sorted or gathered. Rows that share the k-th key are all selected. Null and blank texts have no grams and
weight 0. The noise is a function of doc_id and seed, so reruns agree and repeated rows go together; a null
doc_id has noise of its own. An empty table gives an empty one; without good labels all weights are 0. Only
doc_id and text are read by ``resampled``, so other columns may have any name; ``select_documents`` keeps all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import stash, texts_of
from .wordhash import NOT_SPACE, ALNUM, U, buffers, mix, spans, words

BUCKETS = 10_000
#: Labelled rows that the target model is fitted on, at most.
FIT_ROWS = 20_000
SMOOTH = 0.5


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every gram, grams per text): all unigrams and bigrams of the batch, by text."""
    a, b = words(data, offsets, ALNUM), words(data, offsets, NOT_SPACE & ~ALNUM)
    at = np.concatenate([a.start, b.start])
    order = np.argsort(at, kind="stable")
    h = np.concatenate([a.hash, b.hash])[order]
    first = a.first + b.first
    if not len(h):
        return np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    pair = mix(h[:-1] * U(0xD1342543DE82EF95) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    keep = np.ones(len(pair), bool)
    ends = first[1:-1] - 1
    keep[ends[(ends >= 0) & (ends < len(pair))]] = False
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ids = np.concatenate([text, text[:-1][keep]])
    grams = np.concatenate([h, pair[keep]]) % U(buckets)
    order = np.argsort(ids, kind="stable")
    return grams[order].astype(np.int64), np.bincount(ids, minlength=len(offsets) - 1)


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts (2, buckets) of (good, text) rows: of those that are good, and of all."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in spans(offsets):
                grams, per = gram_buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)
                total[1] += np.bincount(grams, minlength=buckets)
                total[0] += np.bincount(grams[np.repeat(good[lo:hi], per)], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["bucket", "good", "raw"])

    out = np.zeros((2, buckets), np.int64)
    for bucket, good, raw in texts_of(docs).mapInArrow(run, "bucket int, good long, raw long").groupBy("bucket").agg(F.sum("good"), F.sum("raw")).collect():
        out[:, bucket] = good, raw
    return out


def log_ratio(counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log(target / raw) of every bucket, smoothed; zeros where there is no target text."""
    if not counts[0].sum():
        return np.zeros(counts.shape[1])
    p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])
    return np.log(p[0] / p[1])


def with_weights(docs: DataFrame, ratio: np.ndarray, grams: str = "n_grams", weight: str = "log_weight") -> DataFrame:
    """docs, all columns, with the number of grams of ``text`` and its log weight: one pass, no shuffle."""
    buckets, at = len(ratio), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for lo, hi in spans(offsets):
                found, per = gram_buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)
                total = np.concatenate([[0.0], np.cumsum(ratio[found])])
                ends = np.cumsum(per)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(per), pa.array(total[ends] - total[ends - per])], [*part.schema.names, grams, weight])

    return texts_of(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(grams, T.LongType()), T.StructField(weight, T.DoubleType())]))


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every row of (doc_id, text)."""
    return with_weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ratio).select("doc_id", "n_grams", "log_weight")


def best_threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors among ``weight >= cut`` for good; between two weights, in their middle."""
    if not len(weight) or good.all():
        return -math.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order].astype(np.int64)
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((1 - g)[::-1])[::-1], [0]])
    ok = np.concatenate([[True], w[1:] > w[:-1], [True]])
    k = int(np.argmin(np.where(ok, errors, len(w) + 1)))
    return -math.inf if k == 0 else math.inf if k == len(w) else float((w[k - 1] + w[k]) / 2)


def kth_key(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column ``key``, by counting 16 bits at a time."""
    if k <= 0:
        return None
    low, rest = 0, k
    shifted = keys.select((F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).alias("key"))  # unsigned order
    for level in (48, 32, 16, 0):
        part = shifted if level == 48 else shifted.where(F.shiftrightunsigned("key", level + 16) == F.lit(low >> (level + 16)))
        counts = sorted(part.select(F.shiftrightunsigned("key", level).bitwiseAND(F.lit(0xFFFF)).alias("d")).groupBy("d").count().collect(), reverse=True)
        for d, n in counts:
            if rest <= n:
                low |= d << level
                break
            rest -= n
        else:
            return None  # fewer than k rows
    low ^= 1 << 63
    return low - (1 << 64) if low >> 63 else low


def gumbel_key(weight, doc_id, seed: int):
    """Log weight plus Gumbel noise, in steps of 2**-20, as a long; the noise is a function of doc_id and seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed), F.lit("gumbel")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.round((weight - F.log(-F.log(uniform))) * F.lit(float(1 << 20))).cast("long")


def fitted(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 10, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS):
    """(log ratio of every bucket, all rows with weight and key, least key that is selected; None for none, -inf for all).

    labels: (doc_id, quality), 1 for target-like texts; rows with a null are ignored, of repeated ids the
    greatest label counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("quality") == 1).alias("good"))
    fit = stash(known.orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id").limit(fit_rows), "fit")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = source.join(F.broadcast(fit.where("good").select("label_id")), F.col("doc_id") == F.col("label_id"), "left").select(F.col("label_id").isNotNull().alias("good"), "text")
    ratio = log_ratio(_counts(marked, buckets))
    scored = stash(weights(source, ratio).withColumn("key", gumbel_key(F.col("log_weight"), F.col("doc_id"), seed)), "weights")
    if k is None:
        own = scored.join(F.broadcast(fit), F.col("doc_id") == F.col("label_id")).where("n_grams > 0")
        seen = own.groupBy("doc_id").agg(F.max("log_weight").alias("log_weight"), F.first("good").alias("good")).orderBy("doc_id").toPandas()  # fit_rows at most
        cut = best_threshold(seen["log_weight"].to_numpy(float), seen["good"].to_numpy(bool))
        k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_key(scored, k)
    return ratio, scored, None if k <= 0 else -(1 << 63) if least is None else least


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 10, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_grams, log_weight, selected) of every row of (doc_id, text)."""
    _, scored, least = fitted(docs, labels, k, seed, buckets, fit_rows)
    return scored.select("doc_id", "n_grams", "log_weight", (F.lit(False) if least is None else F.col("key") >= F.lit(least)).alias("selected"))


def select_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that ``resampled`` selects: weighed again in passing, not joined."""
    ratio, _, least = fitted(docs, labels, k, seed)
    if least is None:
        return docs.limit(0)
    weighed = with_weights(docs, ratio, "_n_grams", "_log_weight")
    return weighed.where(gumbel_key(F.col("_log_weight"), F.col("doc_id").cast("long"), seed) >= F.lit(least)).select(*docs.columns)
