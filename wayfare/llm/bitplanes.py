"""Token ids in bit planes: encode, store, and read back.

Format of one segment (bytes, little-endian), which holds the ids of a run of whole documents:

* ``BPL1``, then uint32 block size, uint32 mode (0: byte planes, 1: bit planes), uint64 number of ids,
  uint32 number of blocks;
* the chunk index: for every block uint32 number of ids, uint32 number of planes, then for each plane
  uint32 compressed size;
* the planes, one after the other, each one zstandard frame. Byte plane p holds byte p of every id of the
  block, bit plane p bit p; planes above the highest one used in the block are left out.

Segments are rows of a Parquet table in the shared folder (payload as binary, next to doc ids, lengths and
the place within the shard), so that Spark's commit protocol covers lost and repeated tasks and any store
that Spark reaches can hold them. A null text is an empty one, an empty table an empty store. Repeated rows are
stored each; equal ids go by text, null ids come first. Only doc_id and text are read, so other columns may have
any name. Documents go to shards by ranges of doc_id; a shard's segments follow
one another, and a shard is one task's work.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh_path, texts_of
from .wordhash import buffers, spans

BLOCK_IDS = 1 << 16
#: Ids from which a segment is closed after the document that reaches it.
SEGMENT_IDS = 1 << 18
BYTE_PLANES, BIT_PLANES = 0, 1
_HEAD = struct.Struct("<4sIIQI")


def pack(ids: np.ndarray, mode: int = BYTE_PLANES, block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """One segment of uint32 ids."""
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    index, planes = [], []
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], dtype="<u4")
        most = int(part.max()).bit_length()
        if mode == BYTE_PLANES:
            raw = part.view(np.uint8).reshape(-1, 4).T[: (most + 7) // 8]
            cut = [np.ascontiguousarray(p) for p in raw]
        else:
            cut = [np.packbits((part >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little") for p in range(most)]
        frames = [press.compress(p.tobytes()) for p in cut]
        index.append(struct.pack(f"<{2 + len(frames)}I", len(part), len(frames), *map(len, frames)))
        planes += frames
    return b"".join([_HEAD.pack(b"BPL1", block, mode, len(ids), len(index)), *index, *planes])


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    magic, _, mode, n, blocks = _HEAD.unpack_from(data)
    if magic != b"BPL1":
        raise ValueError("not a bit-plane segment")
    at, index = _HEAD.size, []
    for _ in range(blocks):
        size, planes = struct.unpack_from("<2I", data, at)
        index.append((size, struct.unpack_from(f"<{planes}I", data, at + 8)))
        at += 8 + 4 * planes
    out, done, open_ = np.zeros(n, "<u4"), 0, zstandard.ZstdDecompressor()
    for size, lengths in index:
        part = out[done : done + size]
        for p, length in enumerate(lengths):
            raw = np.frombuffer(open_.decompress(data[at : at + length]), np.uint8)
            at += length
            if mode == BYTE_PLANES:
                part.view(np.uint8).reshape(-1, 4)[:, p] = raw
            else:
                part |= np.unpackbits(raw, count=size, bitorder="little").astype(np.uint32) << np.uint32(p)
        done += size
    return out


#: The split of the byte-level pre-tokenizer.
_SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space besides the space, tab and line feed: texts that hold one are encoded whole.
_ODD = "".join(chr(c) for c in [0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Classes of bytes: 1 letter, 2 digit, 3 mark, 0 not told by the byte alone (apostrophes, white space, beyond ASCII).
_CLASS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 33 <= b < 127 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)
#: A byte that no UTF-8 text has, between pre-tokens.
_BETWEEN = 0xFF


def _byte_letters() -> list[str]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Ids of whole texts from a ``tokenizers`` file, with what was seen before kept.

    For a byte-level BPE file without normalizer, texts are cut where its pre-tokenizer surely cuts: before a
    lone space, around a lone line feed, and between ASCII letters, digits and marks (not beside apostrophes).
    The different pieces of a span of texts are looked up once; unknown ones go, split further where needed,
    through the library's model, many pre-tokens at a time with a byte between them that no merge knows. Kept
    pieces are bounded: two generations of ``keep`` entries each. Texts with a string of an added token or
    with rare white space, and pieces with letters on which regex engines may differ, are encoded by the
    library in one go, as is everything for other files.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before, letters = spec.get("pre_tokenizer") or {}, _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.quick = (
            spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and all(x in vocabulary for x in letters) and not any(letters[_BETWEEN] in x for x in vocabulary if len(x) > 1)
        )
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = regex.compile("|".join([f"[{_ODD}]", *map(regex.escape, added)]))
        self.whole_re2 = "|".join([f"[{_ODD}]", *map(re.escape, added)])
        self.letters = np.array([ord(x) for x in letters], "<u4")
        if self.quick:
            self.model = Tokenizer(self.tokenizer.model)  # the model alone, for what is cut already
            self.between = vocabulary[letters[_BETWEEN]]
        self.keep, self.known, self.old = keep, {}, {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of one text."""
        return self.column(pa.array([text]))[0].tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, number of ids of each); a null is an empty text."""
        data, offsets = buffers(texts)
        if not self.quick:
            parts = [np.frombuffer(self._library(x or ""), "<u4") for x in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *parts]), np.array([len(x) for x in parts], np.int64)
        whole = np.flatnonzero(pc.match_substring_regex(texts.cast(pa.large_string()), self.whole_re2).fill_null(False).to_numpy(zero_copy_only=False))
        ids, counts = [], []
        for lo, hi in spans(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            some, per = self._span(part, at, whole[(whole >= lo) & (whole < hi)] - lo)
            ids.append(some)
            counts.append(per)
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *counts])

    def _span(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = _cuts(data, offsets, whole)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which, found = coded.indices.to_numpy(), self._pieces(coded.dictionary.to_pylist())
        size = np.array([len(x) >> 2 for x in found], np.int64)
        start = np.cumsum(size) - size
        own = size[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], own)]
        return ids, np.diff(ends[np.searchsorted(places, offsets)])

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        out = list(map(self.known.get, pieces))
        new = [k for k, x in enumerate(out) if x is None]
        if not new:
            return out
        split, want = {}, []
        for k in new:
            piece = pieces[k]
            got = self.old.get(piece)
            if got is not None:
                out[k] = got
            elif _single(piece):
                want.append(piece)
            else:
                text = piece.decode("utf-8", "replace")
                if self.whole.search(text) or (not text.isascii() and max(text) > "\u024f"):
                    out[k] = self._library(text)
                else:
                    split[k] = [x.encode() for x in _SPLIT.findall(text)]
        more = {x for parts in split.values() for x in parts}
        done = {x: got for x in more if (got := self.known.get(x)) is not None}
        fresh = [*want, *(more - done.keys() - set(want))]
        done |= zip(fresh, self._pre_tokens(fresh), strict=True)
        for k in new:
            if out[k] is None:
                parts = split.get(k)
                out[k] = done[pieces[k]] if parts is None else b"".join([done[x] for x in parts])
        if len(self.known) + len(new) > self.keep:
            self.known, self.old = {}, self.known
        for x, got in done.items():
            if len(x) <= 64:
                self.known[x] = got
        for k in new:
            if len(pieces[k]) <= 64:
                self.known[pieces[k]] = out[k]
        return out

    def _pre_tokens(self, tokens: list[bytes], at_once: int = 32) -> list[bytes]:
        """Ids of pre-tokens, from the library's model."""
        chunks = [bytes([_BETWEEN]).join(tokens[k : k + at_once]) for k in range(0, len(tokens), at_once)]
        texts = [self.letters[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in chunks]
        out: list[bytes] = []
        for chunk in self.model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(chunk.ids, "<u4")
            ends = np.flatnonzero(ids == self.between).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *(x + 1 for x in ends)], [*ends, len(ids)], strict=True)]
        return out


def _cuts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer cuts for sure, but in the texts that are encoded whole, and where texts begin and end."""
    if not len(data):
        return np.zeros(1, np.int64)
    space, line = data == 32, data == 10
    blank = space | line | (data == 9)
    kind = _CLASS[data]
    free = np.ones(len(data), bool)  # the byte before and the byte after are no white space
    free[1:] &= ~blank[:-1]
    free[:-1] &= ~blank[1:]
    free[0] = free[-1] = False
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    free[edge] = free[edge - 1] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = (space | line) & free
    cut[1:] |= line & free
    cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    for k in whole:
        cut[offsets[k] : offsets[k + 1]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


def _single(piece: bytes) -> bool:
    """Whether a piece is one pre-token for sure."""
    body = piece[1:] if piece[:1] == b" " else piece
    if body.isalpha() or piece == b"\n":
        return True
    if piece.isascii():
        return len(body) > 0 and b"'" not in body and len(set(_CLASS[list(body)])) == 1 and _CLASS[body[0]] > 0
    text = body.decode("utf-8", "replace")
    return text.isalpha() and max(text) <= "\u024f"


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_STORE = "shard int, seq int, place long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, mode: int = BYTE_PLANES, block: int = BLOCK_IDS, shards: int | None = None) -> str:
    """Encode (doc_id, text), append ``end_id`` to each document, and write segments to ``path``.

    Rows go in ascending doc_id, nulls first, equal ids by text; a null text is empty.
    """
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        seq, place, held, ids, lengths, parts = 0, 0, 0, [], [], []

        def segment():
            flat = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([place], pa.int64()), pa.array([len(flat)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(flat, mode, block)], pa.binary()),
                ],
                ["shard", "seq", "place", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            found, counts = encoder.column(batch.column(1))
            ends = np.cumsum(counts)
            for doc, a, b in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                parts += (found[a:b], end)
                ids.append(doc)
                lengths.append(b - a + 1)
                held += lengths[-1]
                if held >= SEGMENT_IDS:
                    yield segment()
                    seq, place, held, ids, lengths, parts = seq + 1, place + held, 0, [], [], []
        if ids:
            yield segment()

    dealt.mapInArrow(run, _STORE).write.option("compression", "uncompressed").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, from its payloads.

    start is the number of ids before it; shard totals, one number a shard, are summed on the driver.
    """
    store = spark.read.schema(_STORE).parquet(path)
    totals = dict(store.groupBy("shard").agg(F.sum("n_ids")).collect())
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]

    def run(batches):
        for batch in batches:
            for shard, place, docs, lengths, payload in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3)), batch.column(4), strict=True):
                ids = unpack(payload.as_buffer().to_pybytes())
                cut = np.concatenate([[0], np.cumsum(lengths)])
                if cut[-1] != len(ids):
                    raise ValueError("a segment's index and payload differ")
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array(cut[:-1] + (base[shard] + place)), pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return store.select("shard", "place", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, mode: int = BYTE_PLANES) -> DataFrame:
    """Write the documents to a store in the shared folder, unless a path is given, and read it back."""
    spark = docs.sparkSession
    return read(spark, write(docs, path or fresh_path(spark, "tokens"), tokenizer, end_id, mode))
