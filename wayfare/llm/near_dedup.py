"""MinHash near-deduplication with tensored banding.

Instead of one independent band of minhashes for each table, two collections of ``m`` short bands are
hashed, and the key of table (i, j) combines band i of the first with band j of the second. So ``m * m``
tables of ``2 * rows`` minhashes each cost only ``2 * m * rows`` minhashes (64 tables of 4 from 32 instead of
256 for similarity 0.85, 100 of 4 from 40 for 0.8). A pair of similarity s shares a key with probability ``(1 - (1 - s**rows)**m) ** 2``:
``m`` is such that all but ``MISS`` of the pairs at the wanted similarity share one.

Steps, none of which gathers an unbounded group:

1. Texts become sets of hashed word shingles; documents with equal sets share one representative.
2. Buckets are keys that two or more representatives share. Their members are compared with the least
   member by signature alone; in buckets with members unlike it, each of these is compared with all others,
   in blocks of ``MEMBERS``. These loose pairs (agreement up to 0.4125 below the similarity) make families of texts
   that can contain links: every two members of a bucket that agree so far are in one family.
3. Families are verified on full sets. A family of more than ``BLOCK`` shingles or ``TEXTS`` texts is dealt by
   hash into blocks; a few pivots of it stand in every block, so that near copies of one text are linked
   there. What is not linked to most of the family after that is compared with all of it, block by block.
   A block gives back only a spanning forest of its links, so output is linear in documents.
4. Connected components of those links are the near-duplicate groups.

Null, empty or blank texts have no shingles, no links, and are kept. A text of fewer words than a shingle
has one shingle, its whole sequence. Rows that repeat a doc_id are treated as that many documents of the
same id: they come out as one row each. A null doc_id is never linked and is kept. Of documents that tie the
least doc_id is kept. An empty table gives an empty one. Only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import beside, components, settle, small_side, stash, texts_of
from .wordhash import U, buffers, grams, mix, spans, words

#: Shingles and texts of a block of a family.
BLOCK, TEXTS = 2_000_000, 512
#: Members of a family that stand in all of its blocks, if it has several.
PIVOTS = 4
#: Share of the pairs at the wanted similarity that share no table, at most.
MISS = 1e-4
#: Members of a bucket that one task holds of each of the two blocks it compares by signature.
MEMBERS = 8192


def agreement(percent: int) -> float:
    """Share of two signatures that must agree for a pair to be worth a look; at the wanted similarity and 32 minhashes fewer do with a probability under 1e-6."""
    return max(0.0, percent / 100 - 0.4125)


class MinHash:
    """Signatures of ``2 * m * rows`` minhashes and their ``m * m`` table keys."""

    def __init__(self, m: int = 8, rows: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 2 * m * rows
        self.m, self.rows, self.n = m, rows, n
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    @classmethod
    def of(cls, percent: int, rows: int = 2) -> MinHash:
        """The smallest one that misses at most ``MISS`` of the pairs of a similarity."""
        s = min(max(percent, 1), 99) / 100
        return cls(max(1, math.ceil(math.log(MISS / 2) / math.log1p(-(s**rows)))), rows)

    def signatures(self, sets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """uint32 (documents, n) from concatenated sets, none of them empty."""
        out = np.empty((len(first) - 1, self.n), np.uint32)
        for j in range(self.n):
            out[:, j] = np.minimum.reduceat(sets * self.a[j] + self.b[j], first[:-1]).astype(np.uint32)
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """int64 (documents, m * m): band i of the first half combined with band j of the second."""
        bands = sig.astype(np.uint64).reshape(len(sig), 2 * self.m, self.rows)
        one = np.zeros(bands.shape[:2], np.uint64)
        for r in range(self.rows):
            one = mix(one + bands[:, :, r] + U(0x9E3779B97F4A7C15))
        pairs = one[:, : self.m, None] * U(0xD1342543DE82EF95) + one[:, None, self.m :]
        table = np.arange(self.m * self.m, dtype=np.uint64).reshape(1, self.m, self.m)
        return mix(pairs + table).reshape(len(sig), -1).view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, first): sorted distinct shingle hashes of every text, concatenated."""
    w = words(data, offsets)
    g, first = grams(w, n)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    parts, sizes = [], np.zeros(len(count), np.int64)
    whole = {}
    for i in short:  # the sequence as one, told apart from shingles by its length
        h = U(0)
        for x in w.hash[w.first[i] : w.first[i + 1]]:
            h = mix(np.array([h], np.uint64) * U(0xD1342543DE82EF95) + x)[0]
        whole[i] = mix(np.array([h], np.uint64) + U(count[i]))
    for i in range(len(count)):
        x = whole.get(i)
        if x is None:
            x = g[first[i] : first[i + 1]]
            if len(x) > 1:
                x = np.sort(x)
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
        sizes[i] = len(x)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column with one value for each row of a 2-d array."""
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _varied(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column of the slices flat[first[i]:first[i + 1]]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * flat.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def sketches(docs: DataFrame, n: int = 3, minhash: MinHash | None = None) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every row; set_key and sig are null for empty sets."""
    minhash = minhash or MinHash()

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in spans(offsets):
                sets, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                starts = np.concatenate([first[:-1][full], [len(sets)]])
                ids, key = batch.column(0).slice(lo, hi - lo), pa.nulls(hi - lo, pa.binary())
                sig = pa.nulls(hi - lo, pa.binary())
                if len(full):
                    other = mix(sets ^ U(0x2545F4914F6CDD1D))
                    both = np.stack([np.add.reduceat(sets, starts[:-1]), np.add.reduceat(other, starts[:-1])], 1)
                    at = np.full(hi - lo, -1)
                    at[full] = np.arange(len(full))
                    take = pa.array(at, mask=at < 0)
                    key, sig = _binary(both).take(take), _binary(minhash.signatures(sets, starts)).take(take)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), key, sig], ["doc_id", "n_shingles", "set_key", "sig"])

    return texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _bucket_rows(reps: DataFrame, minhash: MinHash) -> DataFrame:
    """(bucket, rep): every table key of every representative."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, minhash.n)
            keys = minhash.keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(n), keys.shape[1])))], ["bucket", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def _agree(left: str, right: str, n: int) -> str:
    """SQL for the number of the n signature positions on which two columns agree."""
    return " + ".join(f"cast(substring({left}, {1 + 4 * k}, 4) = substring({right}, {1 + 4 * k}, 4) as int)" for k in range(n))


def loose_links(sig: np.ndarray, far: np.ndarray, half: np.ndarray | None = None, share: float = 0.4375) -> list[tuple[int, int]]:
    """Pairs that connect all rows whose signatures agree on a share or more, or only those between two halves.

    Rows that are not ``far`` count as connected already and are not compared with each other.
    """
    columns, label, out = np.ascontiguousarray(sig.T), np.where(far, np.arange(len(sig)) + 1, 0), []
    for x in np.flatnonzero(far):
        ok = (np.add.reduce(columns == sig[x][:, None], 0, dtype=np.uint16) >= share * sig.shape[1]) & (label != label[x])
        if half is not None:
            ok &= half != half[x]
        for y in np.flatnonzero(ok):
            if label[y] != label[x]:
                out.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return out


def _loose_pairs(members: DataFrame, reps: DataFrame, n: int, share: float = 0.4375, block: int = MEMBERS) -> DataFrame:
    """(a, b) of bucket members that connect all those whose signatures of n positions agree on a share or more.

    First the members of a bucket meet its least member. Where some are unlike it, each of these meets all the
    others, in blocks of ``block`` members; of buckets with the same members one is taken.
    """
    sig = reps.select("rep", "sig")
    hubs = stash(members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    met = beside(members, hubs, "bucket", hubs.count(), "rep").where("rep <> hub")
    pairs = met.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    judged = stash(
        pairs.join(sig.withColumnRenamed("rep", "a").withColumnRenamed("sig", "sa"), "a").join(sig.withColumnRenamed("rep", "b").withColumnRenamed("sig", "sb"), "b").select("a", "b", F.expr(_agree("sa", "sb", n)).alias("agree")), "pairs"
    )
    good = judged.where(F.col("agree") >= share * n).select("a", "b")
    far = judged.where(F.col("agree") < share * n).select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.lit(True).alias("far"))
    mixed = stash(met.where("n > 2").join(far, ["hub", "rep"]).select("bucket").distinct(), "mixed")
    if mixed.isEmpty():
        return good
    rest = stash(met.join(mixed, "bucket").join(far, ["hub", "rep"], "left").select("bucket", "rep", F.coalesce("far", F.lit(False)).alias("far")), "rest")
    own = [F.bit_xor(F.xxhash64("rep", "far", F.lit(k))).alias(f"x{k}") for k in range(2)]
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"), *own).groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    held = rest.join(sizes, "bucket").join(sig, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = held.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("bucket", "rep", "far", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sig")

    def met_in_block(table: pa.Table) -> pa.Table:
        ids, far = table["rep"].to_numpy(), table["far"].to_numpy()
        sig = np.frombuffer(b"".join(x.as_py() for x in table["sig"]), np.uint32).reshape(len(ids), n)
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        links = loose_links(sig, far, None if low == high else table["own"].to_numpy() == low, share)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return good.union(placed.groupBy("bucket", "low", "high").applyInArrow(met_in_block, "a long, b long"))


def forest(sets: list[np.ndarray], sig: np.ndarray, percent: int, half: np.ndarray | None = None, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, or only between its two halves where ``half`` is given.

    Rows of one of ``groups`` count as connected already. Links have ``100 * intersection >= percent * union`` on the full sets. Rows go by size, so that a text
    meets only those of a size that allows a link; rows that are already connected are not compared again.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    vocabulary, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size[order])])
    mark = np.zeros(len(vocabulary), np.int32)
    size, sig, label = size[order], sig[order], np.arange(n) if groups is None else groups[order]
    side = half[order] if half is not None else None
    out = []
    for x in range(1, n):
        lo = int(np.searchsorted(size[:x], -(-size[x] * percent // 100), "left"))
        if lo >= x:
            continue
        ok = label[lo:x] != label[x]
        if side is not None:
            ok &= side[lo:x] != side[x]
        near = np.flatnonzero(ok)
        if not len(near):
            continue
        near = near[(sig[lo:x][near] == sig[x]).sum(1) >= agreement(percent) * sig.shape[1]] + lo
        if not len(near):
            continue
        own = codes[first[x] : first[x + 1]]
        mark[own] = 1
        for at in range(0, len(near), 512):
            part = near[at : at + 512]
            lengths = size[part]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(first[part] - (ends - lengths), lengths)
            inter = np.add.reduceat(mark[codes[places]], ends - lengths)
            for y in part[100 * inter >= percent * (lengths + size[x] - inter)]:
                if label[y] != label[x]:
                    out.append((int(order[y]), int(order[x])))
                    label[label == label[y]] = label[x]
        mark[own] = 0
    return out


def _held(docs: DataFrame, dealt: DataFrame, n: int, minhash: MinHash) -> DataFrame:
    """The rows of dealt, (rep, ...), with the shingles and signature of the document rep."""
    names = [c for c in dealt.columns if c != "rep"]
    at = 1 + len(names)

    def shingle(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            for lo, hi in spans(offsets):
                sets, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                part = batch.slice(lo, hi - lo)
                full = np.diff(first) > 0
                if not full.all():  # a family has none; a repeated doc_id may
                    keep = np.flatnonzero(full)
                    first = np.concatenate([first[:-1][keep], [len(sets)]])
                    part = part.take(pa.array(keep))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], _varied(sets, first), _binary(minhash.signatures(sets, first))], ["rep", *names, "shingles", "sig"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select("rep", *names).schema)
    return texts.join(small_side(dealt, dealt.count()), "rep").select("rep", *names, "text").mapInArrow(shingle, f"{kinds}, shingles binary, sig binary")


def _linked_in(placed: DataFrame, keys: list[str], percent: int, n: int) -> DataFrame:
    """(a, b) of the forest of every group of placed rows: (rep, ask, label, shingles, sig).

    Where a group has rows with and without ``ask``, only pairs of both kinds are compared; rows with the same
    label are connected already.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, asks = table["rep"].to_numpy(), table["ask"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        sig = np.frombuffer(b"".join(x.as_py() for x in table["sig"]), np.uint32).reshape(len(ids), n)
        groups = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        pairs = forest(sets, sig, percent, asks if asks.any() else None, groups) if len(ids) > 1 else []
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(ids[y]) for _, y in pairs], pa.int64())})

    return placed.groupBy(*keys).applyInArrow(run, "a long, b long")


def _blocks(shingles: str, texts: str, block: int, most: int):
    return F.greatest(F.ceil(F.col(shingles) / F.lit(block)), F.ceil(F.col(texts) / F.lit(most))).cast("int")


def _own(blocks: str, salt: str):
    return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(blocks)).cast("int")


def _verified(docs: DataFrame, family: DataFrame, n: int, percent: int, minhash: MinHash, block: int, texts: int) -> DataFrame:
    """(a, b) links on full sets that connect every family; family: (rep, family, n_shingles)."""
    pivots = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), F.col("rep"))).getField("rep").alias(f"p{k}") for k in range(PIVOTS)]
    sizes = stash(family.groupBy("family").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("texts"), F.array(*pivots).alias("pivots")).withColumn("blocks", _blocks("total", "texts", block, texts)), "sizes")
    dealt = beside(family, sizes, "family", sizes.count(), "rep").withColumn("own", _own("blocks", "own")).withColumn("pivot", F.array_contains("pivots", F.col("rep")))
    dealt = stash(dealt.select("rep", "family", "blocks", "own", "pivot", "n_shingles"), "family")
    # a pivot of a family of several blocks stands in all of them
    held = _held(docs, dealt, n, minhash).withColumn("own", F.explode(F.when(F.col("pivot"), F.expr("sequence(0, blocks - 1)")).otherwise(F.array("own"))))
    links = _linked_in(held.select("rep", "family", "own", F.lit(False).alias("ask"), F.col("rep").alias("label"), "shingles", "sig"), ["family", "own"], percent, minhash.n)
    several = dealt.where("blocks > 1")
    if several.isEmpty():
        return links
    links = stash(links, "within")
    groups = components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    labelled = stash(several.join(groups, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    most = labelled.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", F.negative("label"))).alias("main"))
    families = stash(beside(labelled, stash(most, "main"), "family", sizes.count(), "rep").withColumn("far", F.col("label") != F.col("main")), "far")
    rest = stash(families.where("far").groupBy("family").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("texts")).withColumn("chunks", _blocks("total", "texts", block, texts)).select("family", "chunks"), "rest")
    count = rest.count()
    if not count:
        return links
    # rows apart from most of their family meet all of it: every chunk of them in every block
    again = stash(beside(families, rest, "family", count, "rep").select("rep", "family", "blocks", "own", "label", "far", "chunks"), "again")
    held = _held(docs, again, n, minhash)
    kept = ["rep", "family", "own", "chunk", "ask", "label", "shingles", "sig"]
    holds = held.withColumn("ask", F.lit(False)).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    asks = held.where("far").withColumn("ask", F.lit(True)).withColumn("chunk", _own("chunks", "chunk")).withColumn("own", F.explode(F.expr("sequence(0, blocks - 1)")))
    return links.union(_linked_in(holds.select(*kept).union(asks.select(*kept)), ["family", "own", "chunk"], percent, minhash.n))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, minhash: MinHash | None = None, block: int = BLOCK, texts: int = TEXTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text).

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of n-word shingles,
    A-Z lower-cased; component_id is the least doc_id that links reach, and kept marks the row of that id.
    """
    minhash = minhash or MinHash.of(percent)
    drawn = stash(sketches(docs, n, minhash), "sketches")
    whole = drawn.where("set_key is not null and doc_id is not null")
    reps = stash(whole.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "reps")

    def loose_pairs():
        keyed = _bucket_rows(reps, minhash)
        shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
        return _loose_pairs(stash(keyed.join(shared, "bucket"), "members"), reps, minhash.n, agreement(percent))

    def linked():
        family = components(loose).join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node").select(F.col("node").alias("rep"), F.col("component").alias("family"), "n_shingles")
        return components(settle(lambda: _verified(docs, family, n, percent, minhash, block, texts), "links"))

    loose = settle(loose_pairs, "loose")
    groups = None if loose.isEmpty() else settle(linked, "groups")
    by_set = reps.select("set_key", "rep")
    if groups is not None:
        by_set = by_set.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    else:
        by_set = by_set.select("set_key", F.col("rep").alias("component"))
    out = beside(drawn, by_set, "set_key", reps.count(), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
