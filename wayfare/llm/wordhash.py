"""Vectorised word splitting and 64-bit hashing over Arrow string buffers.

A word is a maximal run of "word bytes" of the UTF-8 text; which bytes count is a 256-entry table.
Every word gets a 64-bit hash without a Python object being made for it: with random odd ``B`` and a
random table ``T``, ``S[i] = sum_{k<i} T[byte_k] * B**k`` (mod 2**64) is one cumulative sum, and a word
over bytes ``[s, e)`` hashes to ``mix((S[e] - S[s]) * B**-s)``, which does not depend on its place.

Equal hashes are taken for equal words. Hashes of this family can be made to collide on purpose, by words of
1,024 bytes and more; words that nobody made to collide do so once in 2**64.

Nulls count as empty texts. Long buffers are worked on in spans of about ``SPAN`` bytes that end outside
words, so the scratch memory does not grow with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPAN = 1 << 17
_rng = np.random.default_rng(20240611)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SPAN + 4096)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
        if size > 64 * SPAN:  # a giant word made the table long: do not keep it
            del _powers[base]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(word_bytes) -> np.ndarray:
    """256 booleans from a set of byte values, or from a predicate on them."""
    return np.array([word_bytes(b) if callable(word_bytes) else b in word_bytes for b in range(256)])


#: Everything but the space and \t \n \v \f \r.
NOT_SPACE = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, a-z and every byte of a character beyond ASCII, for text in which A-Z were lower-cased.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: As ALNUM, but without digits.
LETTERS = table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: The byte map that lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_LOWER_TABLE = _TABLE[LOWER]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``start`` and ``end`` (byte places), ``hash``, and ``first[i]:first[i + 1]`` of text i."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hashes, first):
        self.start, self.end, self.hash, self.first = start, end, hashes, first


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE, hashed: bool = True) -> Words:
    """Split every text into words; hashes are of the words with A-Z lower-cased."""
    n = len(data)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        stop = min(n, at + SPAN)
        while stop < n and word_bytes[data[stop]]:
            # move on to the next byte that is in no word, in steps
            part = data[stop : stop + 65536]
            gap = np.flatnonzero(~word_bytes[part])
            stop += int(gap[0]) if len(gap) else len(part)
        part = data[at:stop]
        m = np.zeros(len(part) + 2, bool)
        m[1:-1] = word_bytes[part]
        cut = inner[np.searchsorted(inner, at, "left") : np.searchsorted(inner, stop, "left")] - at
        s = m[1:-1] & ~m[:-2]
        e = m[1:-1] & ~m[2:]
        if len(cut):
            s[cut] = m[1:-1][cut]
            cut = cut[cut > 0]
            e[cut - 1] = m[1:-1][cut - 1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        if hashed and len(s):
            acc = np.empty(len(part) + 1, np.uint64)
            acc[0] = 0
            v = _LOWER_TABLE[part]
            v *= _pow(_B, len(part))[: len(part)]
            np.cumsum(v, out=acc[1:])
            h = (acc[e] - acc[s]) * _pow(_BINV, len(part) + 1)[s]
            hashes.append(mix(h ^ (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return Words(start, end, hashes, np.searchsorted(start, offsets, "left"))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the n-word sequences of every text, in order, repeats included."""
    h, count = w.hash, len(w.hash)
    per = np.maximum(np.diff(w.first) - (n - 1), 0)
    first = np.concatenate([[0], np.cumsum(per)])
    if count < n:
        return np.empty(0, np.uint64), first
    out = np.zeros(count - n + 1, np.uint64)
    for k in range(n):
        out += h[k : count - n + 1 + k] * U(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    keep = np.ones(count - n + 1, bool)
    for k in range(1, n):  # sequences that start fewer than n words before the end of a text
        at = w.first[1:-1] - k
        at = at[(at >= w.first[:-2]) & (at >= 0) & (at < len(keep))]
        keep[at] = False
    return mix(out[keep]), first


def spans(offsets: np.ndarray, most: int = 1 << 22):
    """Slices of consecutive texts of ``most`` bytes at the most, or of one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(stop, n)
        at = min(stop, n)


def prefixes(data: np.ndarray, w: Words, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length n, (words longer than n bytes, hash of their first n bytes); A-Z are lower-cased."""
    size, powers = w.end - w.start, _pow(_B, max(lengths, default=0) + 1)
    at = np.flatnonzero(size > min(lengths, default=0))
    out, h, done = {}, np.zeros(len(at), np.uint64), 0
    for n in sorted(lengths):
        keep = size[at] > n
        at, h = at[keep], h[keep]
        for k in range(done, n):
            h = h + _LOWER_TABLE[data[w.start[at] + k]] * powers[k]
        done = n
        out[n] = (at, h)
    return out


def suffixes(data: np.ndarray, w: Words, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """As prefixes, of the last n bytes."""
    size, powers = w.end - w.start, _pow(_B, max(lengths, default=0) + 1)
    at = np.flatnonzero(size > min(lengths, default=0))
    out, h, done = {}, np.zeros(len(at), np.uint64), 0
    for n in sorted(lengths):
        keep = size[at] > n
        at, h = at[keep], h[keep]
        for k in range(done, n):
            h = h + _LOWER_TABLE[data[w.end[at] - 1 - k]] * powers[k]
        done = n
        out[n] = (at, h)
    return out
