"""Benchmark decontamination with one Aho-Corasick automaton.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII; texts are normalised to
their words with one space around each. Every window of ``n`` consecutive words of an item, or the whole
item if it is shorter, is one key of the automaton. A document is scanned once; every occurrence marks its
words, which are mapped back to offsets in the original text.

An automaton has one node for each different beginning of a key, at about 50 bytes; windows share few, so it is much larger
than its items. The windows are put into automata of at most ``chunk_bytes`` bytes of keys; a long item is divided. With one
automaton, as for all but large benchmarks, the documents are scanned in passing. With several, they are written once with a row
number, each automaton scans them in tasks of its own, so that a core holds one at a time, and what was found is put together by
row. The items, not the documents, go through the driver.

Null and empty texts have no words and no hits; items that are null, have no word, or have a null id are
ignored; repeated ids count once, repeated documents each. Items that tie in a window are all found. Empty tables
give no rows or no hits. Of documents only doc_id and text are read by ``matches``, so other columns may have any
name; ``clean_documents`` keeps all columns.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_side, stash, texts_of
from .wordhash import ALNUM, LOWER, buffers, words

#: Bytes of keys, and so nodes at most, of one automaton: about 200 MB.
CHUNK_BYTES = 4_000_000
_NORMAL = bytes(LOWER[b] if ALNUM[b] else 32 for b in range(256))
_built: dict[tuple, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def automaton(items: list[tuple[int, str]], n: int):
    """(automaton, windows): each key leads to (items that have it, its number of words)."""
    windows: dict[bytes, tuple[set, int]] = {}
    for item, text in items:
        w = normal_words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            part = w[k : k + n]
            windows.setdefault(b" " + b" ".join(part) + b" ", (set(), len(part)))[0].add(item)
    found = ahocorasick.Automaton()
    for key, what in windows.items():
        found.add_word(key.decode("latin-1"), what)
    found.make_automaton()
    return found, len(windows)


def _cached(items: list[tuple[int, str]], n: int):
    """The automaton of this worker process: built once, however many tasks it runs."""
    key = (n, hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest())
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items, n)
    return _built[key]


def scan(found, n_windows: int, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """(words, merged [first, last) word ranges that are hit, items) of one text."""
    w = text.translate(_NORMAL).split()
    if not w or not n_windows:
        return len(w), [], set()
    normal = b" " + b" ".join(w) + b" "
    ends, items = [], set()
    for at, (ids, size) in found.iter(normal.decode("latin-1")):
        ends.append((at, size))
        items |= ids
    if not ends:
        return len(w), [], items
    gaps = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    last = np.searchsorted(gaps, [at for at, _ in ends])  # the space at the end of word k is gap k + 1
    return len(w), union(zip((last - [s for _, s in ends]).tolist(), last.tolist(), strict=True)), items


def union(ranges) -> list[tuple[int, int]]:
    """Ranges in order, those that meet made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _slices(item: int, text: str, n: int, most: int) -> list[tuple[int, str, int]]:
    """(item, text, bytes of keys) of an item, or of stretches of it that have all its windows, if it has more than ``most``."""
    w = normal_words(text)
    ends = np.cumsum([0, *(len(x) + 1 for x in w)])
    wide = min(n, len(w))
    keys = ends[wide:] - ends[: len(ends) - wide] + 1 if w else np.zeros(0, np.int64)
    if keys.sum() <= most:
        return [(item, text, int(keys.sum()))]
    out, first, held = [], 0, 0
    for k, size in enumerate(keys.tolist()):
        if held and held + size > most:
            out.append((first, k, held))
            first, held = k, 0
        held += size
    out.append((first, len(keys), held))
    return [(item, b" ".join(w[a : b + n - 1]).decode("utf-8", "surrogatepass"), size) for a, b, size in out]


def _chunks(items: DataFrame, n: int, chunk_bytes: int) -> list[list[tuple[int, str]]]:
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    out, held = [[]], 0
    for item, text in rows.toLocalIterator():
        for own in _slices(item, text, n, chunk_bytes):
            if held and held + own[2] > chunk_bytes:
                out.append([])
                held = 0
            out[-1].append(own[:2])
            held += own[2]
    return out


_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _found(rows: DataFrame, parts: list[list[tuple[int, str]]], n: int) -> DataFrame:
    """(row, ranges, item_ids) of the rows (row, text) that some automaton finds something in; one for each automaton that does."""

    def scanner(part):
        def run(batches):
            found, count = _cached(part, n)
            for batch in batches:
                out = [(row, *scan(found, count, x.encode("utf-8", "surrogatepass"))[1:]) for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x]
                hit = [(row, [{"first": a, "last": b} for a, b in ranges], sorted(ids)) for row, ranges, ids in out if ranges]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], _RANGES), pa.array([x[2] for x in hit], pa.list_(pa.int64()))], ["row", "ranges", "item_ids"])

        return run

    return reduce(DataFrame.unionByName, (rows.select("row", "text").mapInArrow(scanner(p), "row long, ranges array<struct<first:long,last:long>>, item_ids array<long>") for p in parts))


def matches(docs: DataFrame, items: DataFrame, n: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) of every row of (doc_id, text).

    item_ids are sorted as strings; spans are [start, stop) byte offsets in the UTF-8 of the original text,
    from the first to the last hit word of each merged range.
    """
    source = texts_of(docs).select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    parts = _chunks(items, n, chunk_bytes)
    if len(parts) > 1:
        rows = stash(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        # one row an automaton at most
        merged = _found(rows, parts, n).groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        source = rows.join(merged, "row", "left").select("doc_id", "text", "ranges", "item_ids")

    def run(batches):
        found, count = _cached(parts[0], n) if len(parts) == 1 else (None, 0)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            raw = data.tobytes()
            ranges_before, ids_before = (batch.column(k).to_pylist() for k in (2, 3)) if found is None else ([], [])
            sizes, ids, ranges_of, spans_of = [], [], [], []
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                if found is None:
                    size, ranges, own = len(text.translate(_NORMAL).split()), union([(x["first"], x["last"]) for x in ranges_before[i] or []]), ids_before[i] or []
                else:
                    size, ranges, own = scan(found, count, text)
                sizes.append(size)
                ids.append([*own])
                ranges_of.append([{"first": a, "last": b} for a, b in ranges])
                w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM, hashed=False) if ranges else None
                spans_of.append([{"start": int(w.start[a]), "stop": int(w.end[b - 1])} for a, b in ranges])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans_of, _SPANS), pa.array(ranges_of, _RANGES), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "ranges", "item_ids"])

    out = source.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<start:long,stop:long>>, ranges array<struct<first:long,last:long>>, item_ids array<long>")
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"])
    ids = F.array_sort("item_ids", lambda x, y: F.when(x.cast("string") < y.cast("string"), -1).when(x.cast("string") > y.cast("string"), 1).otherwise(0))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), ids.alias("item_ids"), "spans")


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that no window occurs in: with one automaton a filter in passing, not a join."""
    parts, at = _chunks(items, n, chunk_bytes), docs.columns.index("text")
    if len(parts) > 1:
        row = "_row"
        while row in docs.columns:
            row += "_"
        rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        gone = stash(_found(texts_of(rows).select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), parts, n).select("row").distinct(), "gone")
        gone = small_side(gone, gone.count())
        return rows.join(gone, rows[row] == gone["row"], "left_anti").drop(row)

    def run(batches):
        found, count = _cached(parts[0], n)
        for batch in batches:
            texts = batch.column(at)
            keep = [x is None or not scan(found, count, x.encode("utf-8", "surrogatepass"))[1] for x in texts.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return texts_of(docs).mapInArrow(run, docs.schema)
