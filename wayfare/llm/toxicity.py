"""Toxicity with noisy-channel deobfuscation.

Spans of text that look written to hide a word are found by pattern: words with digits or symbols for
letters, single letters of any script kept apart by spaces or marks, and letters repeated three times or more.
Each becomes a lattice with the letters that a character may stand for (or, at a cost, itself), repetition as
one or two of a letter, and separators dropped or left as spaces between words; Viterbi decoding under a
character trigram model of the corpus and channel costs picks the text that was meant. Text outside such spans
has a lattice of one path and stays. Finding and decoding are linear in the text, whatever stands in it.

The restored spans, beside the whole original text, are scored by a model on word and word-prefix features,
A-Z lower-cased: features that occur in ``MIN_DOCS`` training texts or more and whose share among toxic texts
is beyond doubt (z > ``MIN_Z``) have weights, and a logistic curve maps the two largest weights and the
bounded sum of a text to a score.

The character model counts every text. The classifier is fitted on at most ``FIT_ROWS`` labelled rows, those
least by a hash of doc_id; at most ``FEATURES`` features are kept, those of the highest z.

Null, empty and blank texts get the score of a text without features. Repeated rows are scored alike, rows
of a null doc_id are scored and never trained on; ties among features go by their hash. An empty table gives
an empty one, and without labels all scores are those of an even prior. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import re
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash, texts_of
from .lm import CharModel, trigram_counts
from .wordhash import LETTERS, U, buffers, mix, prefixes, spans, words

FIT_ROWS, FEATURES, MIN_DOCS, MIN_Z = 20_000, 20_000, 4, 4.5
PREFIXES = (4, 5, 6, 7)

# -- fixed values: what characters may stand for ------------------------------------------------------------
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
}
# -----------------------------------------------------------------------------------------------------------
_SYM = re.escape("".join(LEET))
_L = r"[^\W\d_]"
#: Separators that keep single letters apart.
_SEP = r"[ ._\-*~'/|]"
#: No branch goes back over what it took, and none starts within a word: matching is linear.
_FIND = re.compile(
    rf"(?<![^\W_])(?:{_L}|[0134578@$!])(?:{_SEP}{{1,2}}(?:{_L}|[0134578@$!])(?![^\W_])){{2,}}+"  # s t u p i d
    rf"|(?<!{_L})[@$0-9]?{_L}++(?:[{_SYM}]++{_L}++)++[0-9$@]*+"  # 1d10t
    rf"|(?<![^\W_])(?<![@$!])[@$0134578!]++{_L}{{2,}}+(?:[{_SYM}]++{_L}++)*+[0-9$@]*+"  # $tupid
    rf"|(?<!{_L}){_L}(?:{_L}++[0134578$@]++|[0134578$@]{{2,}}+)(?![\w$@])",  # dumba55
    re.IGNORECASE,
)
_TRIPLE, _WORD = re.compile(rf"({_L})\1{{2,}}", re.IGNORECASE), re.compile(r"\w+")  # stuuupid
CHANNEL, DROP, KEEP = -1.0, -0.5, -6.0


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step, what it may emit (0 to 2 letters) and its channel cost."""
    out: list[list[tuple[str, float]]] = []
    spaced = re.fullmatch(rf"(?:[^\W_]|[@$!])(?:{_SEP}{{1,2}}(?:[^\W_]|[@$!]))+", span) is not None
    at = 0
    while at < len(span):
        c = span[at].lower()
        run = 1
        while at + run < len(span) and span[at + run].lower() == c:
            run += 1
        if c.isalpha():
            if run >= 3:
                out.append([(c, -0.1), (c + c, -0.4)])
            else:
                out.append([(c, 0.0)] * 1 if run == 1 else [(c + c, 0.0)])
            at += run
        elif spaced and re.match(_SEP, c) and c not in "@$":
            out.append([("", 0.0), (" ", -0.1 if run == 1 else 0.0)])
            at += run
        else:
            options = [(x, CHANNEL) for x in LEET.get(c, "")]
            if run > 1 and options:
                options += [(x + x, CHANNEL) for x in LEET[c] if run == 2] + [("", DROP - 2.0)]
            elif c in "*.-_~#%&":
                options.append(("", DROP - 1.0))
            out.append([*(options or [("", DROP)]), (c * run, KEEP * run)])
            at += run
    return out


def decode(span: str, model: CharModel) -> str:
    """The best path of a span's lattice: Viterbi over the last two symbols; what all paths begin with is set aside."""
    table, symbol, done = model.table, model.symbol, []
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for step, options in enumerate(lattice(span)):
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in paths.items():
            for emit, cost in options:
                s, x, y = score + cost, a, b
                for c in emit:
                    k = symbol(c)
                    s += float(table[x, y, k])
                    x, y = y, k
                key = (x, y)
                if key not in nxt or s > nxt[key][0] or (s == nxt[key][0] and text + emit < nxt[key][1]):
                    nxt[key] = (s, text + emit)
        paths = nxt
        if step % 64 == 63:
            done.append(commonprefix([text for _, text in paths.values()]))
            paths = {key: (score, text[len(done[-1]) :]) for key, (score, text) in paths.items()}
    return "".join(done) + max(((s + float(table[a, b, 0]), text) for (a, b), (s, text) in paths.items()), key=lambda p: (p[0], p[1]))[1]


class Restorer:
    """Restores texts; spans decoded before are kept, at most ``keep``."""

    def __init__(self, model: CharModel, keep: int = 200_000):
        self.model, self.keep, self.known = model, keep, {}

    def span(self, match: re.Match) -> str:
        text = match.group(0)
        if len(text) > 200:
            return decode(text, self.model)
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[text] = decode(text, self.model)
        return got

    def __call__(self, text: str) -> tuple[str, str]:
        """(restored text, the restored spans alone)."""
        found = list(_FIND.finditer(text))
        if _TRIPLE.search(text):
            taken, more, k = [m.span() for m in found], [], 0
            for m in _WORD.finditer(text):
                while k < len(taken) and taken[k][1] <= m.start():
                    k += 1
                if (k == len(taken) or taken[k][0] >= m.end()) and _TRIPLE.search(m[0]):
                    more.append(m)
            found = sorted(found + more, key=lambda m: m.start())
        done, parts, at = [], [], 0
        for m in found:
            done.append(self.span(m))
            parts += (text[at : m.start()], done[-1])
            at = m.end()
        return "".join([*parts, text[at:]]), " ".join(done)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) pairs, repeats included: hashes of words and of their prefixes."""
    w = words(data, offsets, LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    parts, owners = [w.hash], [text]
    for n, (at, h) in prefixes(data, w, PREFIXES).items():
        parts.append(mix(h + U(n)))
        owners.append(text[at])
    return np.concatenate(parts), np.concatenate(owners)


_ASCII_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_ALONE = np.array([b < 0x80 and (chr(b).isalnum() or chr(b) in "@$!") for b in range(256)])
_ANY_SYM = np.array([chr(b) in LEET for b in range(256)])
_END_SYM = np.array([chr(b) in "0134578$@" for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
#: Bytes around a suspicious byte that are looked at, before the ends are moved to white space.
REACH = 48


def suspicious(data: np.ndarray) -> np.ndarray:
    """Places where a hidden word may be: a quick test on bytes that every span passes.

    These are symbols before or after letters, three equal letters in a row, and single letters or digits,
    of one to three bytes, that are one or two bytes apart.
    """
    n = len(data)
    pad = np.full(n + 16, 32, np.uint8)
    pad[8 : n + 8] = data
    letter = LETTERS[pad]

    def at(k: int, of: np.ndarray) -> np.ndarray:
        return of[8 + k : n + 8 + k]

    hit = at(0, _ANY_SYM[pad]) & at(1, letter)
    hit |= at(0, _END_SYM[pad]) & at(-1, letter)
    low = pad | 0x20
    hit |= at(0, _ASCII_LETTER[pad]) & (at(0, low) == at(1, low)) & (at(0, low) == at(2, low))
    start = _ALONE[pad]
    start[1:-1] &= ~(letter[:-2] | letter[2:])
    end = np.roll(start, 1)
    if (data >= 0xC3).any():
        for size, first, last in ((2, 0xC3, 0xDF), (3, 0xE0, 0xEF)):
            lead = (pad >= first) & (pad <= last)
            same = at(0, lead)
            for k in range(size):
                same = same & (at(k, pad) == at(k + size, pad)) & (at(k, pad) == at(k + 2 * size, pad))
            hit |= same
            alone = lead & ~np.roll(letter, 1) & ~np.roll(letter, -size)
            start = start | alone
            end = end | np.roll(alone, size)
    hit |= at(0, start) & (at(-1, end) | at(-2, end))
    return np.flatnonzero(hit)


def _windows(data: np.ndarray, offsets: np.ndarray):
    """(text, start, stop): merged surroundings of suspicious places, ending at white space or the text's ends."""
    places = suspicious(data)
    if not len(places):
        return
    gaps = np.flatnonzero(_SPACE[data])
    text = np.searchsorted(offsets, places, "right") - 1
    if len(gaps):
        k = np.searchsorted(gaps, places - REACH, "right") - 1
        lo = np.where(k >= 0, gaps[np.maximum(k, 0)] + 1, 0)
        k = np.searchsorted(gaps, places + REACH, "left")
        hi = np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)], len(data))
    else:
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(data))
    lo, hi = np.maximum(lo, offsets[text]), np.minimum(hi, offsets[text + 1])
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])])
    first = np.flatnonzero(new)
    yield from zip(text[first].tolist(), lo[first].tolist(), np.maximum.reduceat(hi, first).tolist(), strict=True)


def _restored_features(texts: pa.Array, restore: Restorer):
    """Features of the texts and of their restored spans."""
    data, offsets = buffers(texts)
    for lo, hi in spans(offsets, 1 << 21):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        f, owner = features(part, at)
        raw, found, whose = part.tobytes(), [], []
        for i, start, stop in _windows(part, at):
            got = restore(raw[start:stop].decode("utf-8", "replace"))[1]
            if got:
                found.append(got)
                whose.append(i)
        more, more_owner = features(*buffers(pa.array(found, pa.string())))
        yield lo, hi, np.concatenate([f, more]), np.concatenate([owner, np.array(whose, np.int64)[more_owner]])


_restorers: dict[int, Restorer] = {}


def _restorer(table: np.ndarray) -> Restorer:
    key = hash(table.tobytes())
    if key not in _restorers:
        _restorers.clear()
        model = CharModel.__new__(CharModel)
        model.table = table
        from .lm import ALPHABET

        model.index = {c: i + 2 for i, c in enumerate(ALPHABET)}
        _restorers[key] = Restorer(model)
    return _restorers[key]


class Classifier:
    """Selected features with weights, and the logistic curve over what a text has of them."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, curve: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.curve = keys[order], weights[order], curve
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & U(0xFFFF)).astype(np.int64)] = True

    def evidence(self, f: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n, 2): the largest weight, and the sum of distinct weights, capped, of every text."""
        out = np.zeros((n, 2))
        some = np.flatnonzero(self.maybe[(f & U(0xFFFF)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, f[some]), len(self.keys) - 1)
        hit = self.keys[at] == f[some]
        pairs = np.unique(owner[some][hit].astype(np.int64) * len(self.keys) + at[hit])
        who, w = pairs // len(self.keys), self.weights[pairs % len(self.keys)]
        np.maximum.at(out[:, 0], who, w)
        np.add.at(out[:, 1], who, w)
        out[:, 1] = np.clip(out[:, 1], -5, 20)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.curve[0] + evidence @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; an even prior where there is nothing to learn from."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    if not len(y):
        return w
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, fit_rows: int = FIT_ROWS, seed: int = 2) -> Classifier:
    """A classifier from (doc_id, text) and (doc_id, toxic); rows with nulls are ignored, the greatest label of an id counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") == 1).alias("toxic"))
    fit = stash(known.orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id").limit(fit_rows), "fit")
    rows = docs.join(F.broadcast(fit), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", F.col("text").cast("string").alias("text"))

    def found(batches):
        restore = _restorer(table)
        for batch in batches:
            for lo, hi, f, owner in _restored_features(batch.column(2), restore):
                pairs = np.unique(np.rec.fromarrays([owner.astype(np.int64), f.view(np.int64)], names="o,f"))
                first = np.searchsorted(pairs.o, np.arange(hi - lo + 1))
                flat = np.ascontiguousarray(pairs.f)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))], ["toxic", "f"])

    seen = stash(rows.mapInArrow(found, "toxic boolean, f array<long>"), "fit-features")
    totals = dict(seen.groupBy("toxic").count().collect())
    nt, nn = totals.get(True, 0), totals.get(False, 0)
    if not nt or not nn:
        share = (nt + 0.5) / (nt + nn + 1)
        return Classifier(np.empty(0, np.uint64), np.empty(0), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    counts = seen.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).where(f"a + b >= {MIN_DOCS}")
    pooled = (F.col("a") + F.col("b")) / F.lit(float(nt + nn))
    z = (F.col("a") / nt - F.col("b") / nn) / F.sqrt(pooled * (1 - pooled) * (1 / nt + 1 / nn) + 1e-12)
    chosen = counts.withColumn("z", z).where(F.abs("z") > MIN_Z).orderBy(F.abs("z").desc(), "f").limit(FEATURES).toPandas()
    keys = chosen["f"].to_numpy(np.int64).view(np.uint64)
    weights = np.log((chosen["a"].to_numpy() + 0.5) / (nt + 1)) - np.log((chosen["b"].to_numpy() + 0.5) / (nn + 1))
    model = Classifier(keys, weights, np.zeros(3))

    def judged(batches):
        for batch in batches:
            f, n = batch.column(1), batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(f.offsets.to_numpy()))
            e = model.evidence(f.flatten().to_numpy().view(np.uint64), owner, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e[:, 0]), pa.array(e[:, 1])], ["toxic", "most", "total"])

    e = seen.mapInArrow(judged, "toxic boolean, most double, total double").toPandas()
    model.curve = fit_curve(e[["most", "total"]].to_numpy(), e["toxic"].to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, train_labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text); only labels of train_labels are seen."""
    source = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = CharModel(trigram_counts(source)).table
    model = train(source, train_labels, table, fit_rows)

    def run(batches):
        restore = _restorer(table)
        for batch in batches:
            for lo, hi, f, owner in _restored_features(batch.column(1), restore):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(model.evidence(f, owner, hi - lo)))], ["doc_id", "score"])

    return source.mapInArrow(run, "doc_id long, score double")
