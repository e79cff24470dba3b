"""A character trigram model counted over a corpus."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import buffers, spans

#: Letters that the model knows: a-z and the small letters of Latin-1 and Latin Extended-A. 0 is what lies
#: between words, 1 any other character.
ALPHABET = [chr(c) for c in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x180)]]
SIZE = len(ALPHABET) + 2
_LOOKUP = np.ones(0x10000, np.int64)
for _i, _c in enumerate(ALPHABET):
    for _x in {_c, _c.upper()}:
        if len(_x) == 1:
            _LOOKUP[ord(_x)] = _i + 2
for _c in " \t\n\r\x0b\x0c.,;:!?()[]{}\"'<>|/\\-_*#$%&+=~^`@0123456789":
    _LOOKUP[ord(_c)] = 0


def codes(data: np.ndarray, chunk: bytes | None = None) -> np.ndarray:
    """Model symbols of the characters of UTF-8 bytes."""
    points = np.frombuffer((chunk if chunk is not None else data.tobytes()).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _LOOKUP[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts (SIZE, SIZE, SIZE) over all texts of a column ``text``; each text begins and ends between words.

    Tasks count on their own; the sums of at most SIZE**3 trigrams reach the driver.
    """

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for lo, hi in spans(offsets, 1 << 20):
                raw = b"\n\n".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi))
                c = codes(data, b"\n\n" + raw + b"\n\n")
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(SIZE**3, np.int64)
    for gram, n in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[gram] = n
    return out.reshape(SIZE, SIZE, SIZE)


class CharModel:
    """log p(c | a, b), interpolated from trigrams, bigrams and unigrams."""

    def __init__(self, counts: np.ndarray):
        tri = counts.astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SIZE)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.table = np.log(p3).astype(np.float32)
        self.index = {c: i + 2 for i, c in enumerate(ALPHABET)}

    def symbol(self, c: str) -> int:
        return self.index.get(c, int(_LOOKUP[min(ord(c), 0xFFFF)]))

    def score(self, word: str) -> float:
        a = b = 0
        total = 0.0
        for c in [*map(self.symbol, word.lower()), 0]:
            total += float(self.table[a, b, c])
            a, b = b, c
        return total / (len(word) + 1)
