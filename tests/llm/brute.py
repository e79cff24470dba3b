"""Plain versions of operators, a loop a row, for small tables."""

import math
import re

import numpy as np
import pyarrow as pa

from wayfare.llm import mixing, wordhash

LOWER = {i: i + 32 for i in range(65, 91)}


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near_groups(texts: dict, n: int, percent: int) -> dict:
    """Least id of each id's group."""
    sets = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := spaced_words(t)) else set() for i, t in texts.items()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def contaminated(text, items: list[str], n: int = 10) -> bool:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    own = words(text)
    windows = {tuple(w[k : k + n]) for t in items if (w := words(t)) for k in range(max(1, len(w) - n + 1))}
    return any(tuple(own[k : k + size]) in windows for size in {len(x) for x in windows} for k in range(len(own) - size + 1))


def gram_counts(text, buckets: int) -> dict[int, int]:
    """Unigrams and bigrams by bucket."""
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x09-\x0D 0-9A-Za-z\x80-\xff]+", (text or "").encode())
    hashes = [wordhash.words(*wordhash.buffers(pa.array([x.decode("latin-1").encode("latin-1").decode("utf-8", "replace")])), np.ones(256, bool)).hash[0] for x in runs]
    pair = lambda a, b: wordhash.mix(np.array([a], np.uint64) * np.uint64(0xD1342543DE82EF95) + b)[0]
    out: dict[int, int] = {}
    for h in [*hashes, *(pair(a, b) for a, b in zip(hashes, hashes[1:], strict=False))]:
        out[int(h % np.uint64(buckets))] = out.get(int(h % np.uint64(buckets)), 0) + 1
    return out


def log_weights(texts: dict, good: set, buckets: int, smooth: float) -> dict:
    grams = {i: gram_counts(t, buckets) for i, t in texts.items()}
    total = lambda ids: [sum(grams[i].get(b, 0) for i in ids) for b in range(buckets)]
    target, raw = total([i for i in grams if i in good]), total(grams)
    p, q = ([(c + smooth) / (sum(x) + smooth * buckets) for c in x] for x in (target, raw))
    return {i: sum(n * (math.log(p[b]) - math.log(q[b])) for b, n in g.items()) for i, g in grams.items()}


def taken(rows: list[tuple], weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, slots: int = mixing.SLOTS, parts: int = mixing.PARTS) -> dict:
    """Words taken of each (doc_id, source, size, h) row, word by word."""
    totals: dict = {}
    for _, source, size, _ in rows:
        totals[source] = totals.get(source, 0) + size
    entries = mixing.plan(list(totals.items()), weights, share, cap, slots)
    n, ranks = round(sum(x["slots"] for x in entries)), {}
    times = {(x["k"], b): 0 for x in entries for b in range(x["blocks"])}
    used = [x for x in entries if x["slots"] > 0]
    for t in range(n):
        point = (t + 1) * mixing.GOLDEN
        point -= math.floor(point)
        x = next(x for x in used if point < x["high"] or x is used[-1])
        r = ranks[x["k"]] = ranks.get(x["k"], -1) + 1
        if r < cap * x["blocks"]:
            times[x["k"], r % x["blocks"]] += 1
    out = {}
    for x in entries:
        at = 0
        own = [r for r in rows if r[1] == x["source"]]
        for doc, _, size, _ in sorted(own, key=lambda r: ((r[3] >> 20) % parts, r[3], r[0] is not None, r[0] or 0, r[2])):
            out[doc] = 0
            for word in range(at, at + size):
                block = next(b for b in range(max(0, word * x["blocks"] // x["source_size"] - 1), x["blocks"]) if word < (b + 1) * x["source_size"] // x["blocks"])
                out[doc] += times[x["k"], block]
            at += size
    return out
