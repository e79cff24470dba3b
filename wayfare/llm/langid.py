"""Language identification with a linear-chain conditional random field over words.

Every word has hashed features: itself (lexicon), its first and last 1 to 4 bytes (affixes), and all of its
byte trigrams (n-grams), A-Z lower-cased. Runs of over ``LONG`` bytes that are mostly beyond ASCII, as of
scripts without spaces, and all of over ``LONGEST``, are cut into words of so many bytes at characters. The field has a weight for each feature and language, and a learned
transition between languages; forward-backward gives each word its distribution. A document's language has the
largest mean over its words, which is the score.

It is trained on every language that occurs, on at most ``FIT_DOCS`` documents a language, at most ``FIT_WORDS`` words of each, as sequences of
which some change language in between, so that transitions are learned for code-switched text. Prediction is
on all words of whole texts; chains of a batch are run side by side in pieces whose products are joined
exactly, so long texts need no long loops.

``und`` with score 0 goes to null texts and texts without a letter, and to all where nothing could be learned.
Rows whose lang is null are never trained on; repeated rows are predicted alike; of languages that tie the
first by name is given. An empty table gives an empty one. Only doc_id and text are read, and lang where it is
learned from, so other columns may have any name. Training is one process on the driver: its work is bounded by
the languages times ``FIT_DOCS``, not by the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import texts_of
from .wordhash import LETTERS, U, buffers, mix, prefixes, spans, suffixes, words

FIT_DOCS, FIT_WORDS, SLOTS = 300, 600, 1 << 18
AFFIXES = (1, 2, 3, 4)
#: Bytes of a piece of a run that is mostly beyond ASCII, and of any other run.
LONG, LONGEST = 48, 1 << 16


def runs(data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
    """Words of letters; runs of LONG bytes or more that are mostly beyond ASCII, as of scripts without spaces, are cut into pieces of characters."""
    w = words(data, offsets, LETTERS, hashed=hashed)
    size = w.end - w.start
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    piece = np.where(2 * (high[w.end] - high[w.start]) >= size, LONG, LONGEST)
    cut = np.flatnonzero(size > piece)
    if not len(cut):
        return w
    more = (size[cut] - 1) // piece[cut]
    at = np.repeat(cut, more)
    place = w.start[at] + piece[at] * (np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1)
    for _ in range(3):  # back to the first byte of a character
        place = place - ((data[place] & 0xC0) == 0x80)
    w = words(data, np.union1d(offsets, place), LETTERS, hashed=hashed)
    w.first = np.searchsorted(w.start, offsets, "left")
    return w


def word_features(data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) pairs of every word's features, in order of words."""
    n = len(w.hash)
    parts, owners = [w.hash], [np.arange(n)]
    for kind, found in ((11, prefixes(data, w, AFFIXES)), (12, suffixes(data, w, AFFIXES))):
        for length, (at, h) in found.items():
            parts.append(mix(h + U(kind * 100 + length)))
            owners.append(at)
    size = w.end - w.start
    inner = np.maximum(size - 2, 0)
    at = np.repeat(np.arange(n), inner)
    place = w.start[at] + np.arange(len(at)) - np.repeat(np.cumsum(inner) - inner, inner)
    low = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    parts.append(mix(low[place].astype(np.uint64) << U(16) | low[place + 1].astype(np.uint64) << U(8) | low[place + 2].astype(np.uint64) | U(77 << 32)))
    owners.append(at)
    slot, owner = np.concatenate(parts) % U(SLOTS), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return slot[order].astype(np.int64), owner[order]


def emissions(data: np.ndarray, w, weights: np.ndarray) -> np.ndarray:
    """(words, languages): summed weights, worked out once for each different word."""
    if not len(w.hash):
        return np.zeros((0, weights.shape[1]), np.float32)
    _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)

    class Some:
        hash, start, end = w.hash[first], w.start[first], w.end[first]

    out = np.empty((len(first), weights.shape[1]), np.float32)
    size = np.concatenate([[0], np.cumsum(Some.end - Some.start)])
    for lo, hi in spans(size, (1 << 19) // max(1, weights.shape[1] // 8)):

        class Part:
            hash, start, end = Some.hash[lo:hi], Some.start[lo:hi], Some.end[lo:hi]

        slot, owner = word_features(data, Part)
        out[lo:hi] = np.add.reduceat(weights[slot], np.searchsorted(owner, np.arange(hi - lo)), axis=0)
    return out[back]


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, width: int = 1024) -> np.ndarray:
    """Posterior of every word of chains first[i]:first[i + 1] by forward-backward.

    The words of all chains are one sequence with a restart at each chain, cut into ``width`` pieces that
    advance together: a first pass multiplies each piece's matrices, which gives every piece's incoming
    forward and backward vectors, and two more passes fill in the words.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    width = max(1, min(width, n // 16, (1 << 22) // k**2))
    steps = -(-n // width)
    p = np.ones((width * steps, k))
    p[:n] = np.exp(emit - emit.max(1, keepdims=True))
    fresh = np.zeros(width * steps, bool)
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    fresh[n:] = True
    a, s = np.exp(move - move.max()), np.exp(start - start.max())
    p, fresh = p.reshape(width, steps, k), fresh.reshape(width, steps)
    product = np.broadcast_to(np.eye(k), (width, k, k)).copy()
    for t in range(steps):
        moved = (product.reshape(-1, k) @ a).reshape(width, k, k)
        moved = np.where(fresh[:, t, None, None], product.sum(2, keepdims=True) * s, moved) * p[:, t, None, :]
        product = moved / moved.max((1, 2), keepdims=True)
    ahead, behind = np.empty((width, k)), np.empty((width, k))
    v = np.ones(k)
    for c in range(width):
        ahead[c] = v
        v = v @ product[c]
        v /= v.max()
    v = np.ones(k)
    for c in range(width - 1, -1, -1):
        behind[c] = v
        v = product[c] @ v
        v /= v.max()
    forward = np.empty((width, steps, k))
    for t in range(steps):
        ahead = np.where(fresh[:, t, None], ahead.sum(1, keepdims=True) * s, ahead @ a) * p[:, t]
        ahead /= ahead.max(1, keepdims=True)
        forward[:, t] = ahead
    for t in range(steps - 1, -1, -1):
        forward[:, t] *= behind
        behind = behind * p[:, t]
        behind = np.where(fresh[:, t, None], (behind @ s)[:, None], behind @ a.T)
        behind /= behind.max(1, keepdims=True)
    out = forward.reshape(-1, k)[:n]
    return out / out.sum(1, keepdims=True)


class Field:
    """A trained field: languages, feature weights (SLOTS, k), start (k) and transition (k, k) scores."""

    def __init__(self, langs: list[str], weights: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.langs, self.weights, self.start, self.move = langs, weights, start, move

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors of all words, first word of each text)."""
        w = runs(data, offsets)
        return marginals(emissions(data, w, self.weights), w.first, self.start, self.move), w.first


def train(samples: list[tuple[str, str]], length: int = 24, batch: int = 128, epochs: int = 4, rate: float = 0.15, seed: int = 3) -> Field | None:
    """A field from (lang, text) pairs by stochastic gradient (Adagrad) on the conditional likelihood."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    pieces: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in langs]
    half = length // 2
    for lang, text in samples:
        data, offsets = buffers(pa.array([text]))
        w = runs(data, offsets)
        slot, owner = word_features(data, w) if len(w.hash) else (np.empty(0, np.int64), np.empty(0, np.int64))
        ends = np.searchsorted(owner, np.arange(len(w.hash) + 1))
        own = pieces[langs.index(lang)]
        for at in range(0, min(len(w.hash), FIT_WORDS), half):
            stop = min(at + half, len(w.hash), FIT_WORDS)
            own.append((slot[ends[at] : ends[stop]], owner[ends[at] : ends[stop]] - at, stop - at))
    have = [i for i in range(k) if pieces[i]]
    if not have:
        return None
    total = sum(map(len, pieces))
    weights, grad2 = np.zeros((SLOTS, k), np.float32), np.full((SLOTS, k), 1e-3, np.float32)
    start, move, g_start, g_move = np.zeros(k), np.zeros((k, k)), np.full(k, 1e-3), np.full((k, k), 1e-3)
    for _ in range(max(20, epochs * total // (2 * batch))):
        # half of the sequences stay in one language, the others may change it in the middle
        one = rng.choice(have, batch)
        two = np.where(rng.random(batch) < 0.5, one, rng.choice(have, batch))
        slots, rows, truth, live = [], [], np.zeros((batch, length), np.int64), np.zeros((batch, length), bool)
        for b in range(batch):
            at = 0
            for lang in (one[b], two[b]):
                s, o, n = pieces[lang][rng.integers(len(pieces[lang]))]
                slots.append(s)
                rows.append(o + (b * length + at))
                truth[b, at : at + n], live[b, at : at + n] = lang, True
                at += n
        slot, row = np.concatenate(slots), np.concatenate(rows)
        emit = np.zeros((batch * length, k))
        np.add.at(emit, row, weights[slot])
        emit = emit.reshape(batch, length, k)
        p, a, s = np.exp(emit - emit.max(2, keepdims=True)), np.exp(move), np.exp(start)
        alpha = np.zeros((batch, length, k))
        v = s * p[:, 0]
        alpha[:, 0] = v = v / v.sum(1, keepdims=True)
        for t in range(1, length):
            v = np.where(live[:, t, None], (v @ a) * p[:, t], v)
            alpha[:, t] = v = v / v.sum(1, keepdims=True)
        post, pair = np.zeros_like(alpha), np.zeros((k, k))
        b = np.ones((batch, k))
        for t in range(length - 1, -1, -1):
            g = alpha[:, t] * b
            post[:, t] = g / g.sum(1, keepdims=True)
            if t:
                x = b * p[:, t]
                joint = alpha[:, t - 1, :, None] * a[None] * x[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pair += joint[live[:, t]].sum(0)
                nb = x @ a.T
                b = np.where(live[:, t, None], nb / nb.sum(1, keepdims=True), b)
        gold = np.eye(k)[truth] * live[:, :, None]
        delta = (gold - post * live[:, :, None]).reshape(-1, k) / batch
        gold_pair = np.zeros((k, k))
        both = live[:, 1:] & live[:, :-1]
        np.add.at(gold_pair, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        used, back = np.unique(slot, return_inverse=True)
        g = np.zeros((len(used), k))
        np.add.at(g, back, delta[row])
        g -= 1e-5 * weights[used]
        grad2[used] += g**2
        weights[used] += (rate * g / np.sqrt(grad2[used])).astype(np.float32)
        g = (gold_pair - pair) / batch - 1e-3 * move
        g_move += g**2
        move += rate * g / np.sqrt(g_move)
        g = (gold[:, 0] - post[:, 0]).mean(0) - 1e-3 * start
        g_start += g**2
        start += rate * g / np.sqrt(g_start)
    return Field(langs, weights, start, move)


def sample(docs: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 3) -> list[tuple[str, str]]:
    """About ``fit_docs`` (lang, text) rows a language, those least by a hash of the text, in that order.

    Of a text of more than about ``FIT_WORDS`` words so many are taken, from a place that a hash chooses in the whole text.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return []
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.3 * fit_docs / n)))))
    u = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11) / F.lit(float(1 << 53)) / share[F.col("lang")]
    start = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.greatest(F.length("text") - 12 * FIT_WORDS, F.lit(0)) + 1).cast("int") + 1
    some = rows.select("lang", u.alias("u"), F.substr("text", start, F.lit(12 * FIT_WORDS)).alias("text")).where("u < 1").distinct().orderBy("u", "lang", "text")
    out: dict[str, list[str]] = {}
    for lang, text in some.limit(3 * fit_docs * len(counts)).select("lang", "text").collect():
        out.setdefault(lang, []).append(text)
    return [(lang, text) for lang in sorted(out) for text in out[lang][:fit_docs]]


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every row of (doc_id, text).

    n_switches counts neighbouring words whose likeliest languages differ.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in spans(offsets, (1 << 21) // (1 if field is None else max(1, len(field.langs) // 8))):
                part, at, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
                langs, score, switches = [None] * n, np.zeros(n), np.zeros(n, np.int64)
                if field is None:
                    first = runs(part, at, hashed=False).first
                else:
                    post, first = field.label(part, at)
                    sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0)])
                    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                    best = mean.argmax(1)
                    score = np.clip(mean.max(1), 0, 1)
                    top = post.argmax(1) if len(post) else np.empty(0, np.int64)
                    change = np.concatenate([[0], np.cumsum(np.concatenate([[0], (top[1:] != top[:-1]).astype(np.int64)]))]) if len(top) else np.zeros(1, np.int64)
                    switches = np.where(np.diff(first) > 1, change[np.minimum(first[1:], len(change) - 1)] - change[np.minimum(first[:-1] + 1, len(change) - 1)], 0)
                    langs = [field.langs[b] for b in best]
                ascii_ = np.concatenate([[0], np.cumsum((part | 0x20) - np.uint8(97) < 26)])
                plain = ascii_[at[1:]] - ascii_[at[:-1]]
                for i in np.flatnonzero(plain == 0) if field is not None else range(n):
                    if field is None or not any(c.isalpha() for c in part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")):
                        langs[i], score[i] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(np.diff(first)), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def identify(docs: DataFrame, labelled: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Predictions for all rows of docs with a field trained on (text, lang) of labelled."""
    return predict(docs, train(sample(labelled, fit_docs)))
