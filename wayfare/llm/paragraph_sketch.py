"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is cut into paragraphs: at line breaks, and in long lines at the first sentence end after ``SHORT`` characters,
or after about ``LONG`` where there is none. The digest of a paragraph is a 64-bit hash of it, without spaces at its
end, and of how many equal ones stand before it: a text is a set of digests, and two texts are as alike
as their sets (shared digests by all digests).

A sketch has three rows of ``WIDTH`` cells. Each digest is in one cell of every row, by its hash; a cell holds the number
of its digests, their exclusive or, and that of their 32-bit checks. Sketches of two versions are subtracted cell by
cell: what they share is gone. A cell that holds one digest (number 1 or -1, and the check fits) gives it away,
with its side; it is taken out of its other cells, and so on. If all cells end up empty, all differing digests are recovered.
If not, the pair is tried again with larger sketches: the digests of both are dealt over parts by a hash, each with a
sketch of its own and another hash, until every part has been recovered. The first sketch is the fingerprint.

A null text is empty: no digests. Two empty texts are alike (1), an empty one and another are not (0). Equal texts have
equal fingerprints, whatever their rows. In ``with_next``, documents stand in order of (doc_id, hash of the text), null ids first;
after the last comes the first, so a single document is its own next one; repeated rows are rows of their own. An empty table
gives an empty one. Only doc_id and text are read, so other columns may have any name. Texts of any length are linear
work: digests are dealt over at most ``PARTS`` parts at a time, again and again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import beside, stash

SHORT, LONG = 40, 400
#: Cells in each of the three rows of a sketch; digests of a part that is tried, about; parts that are dealt at a time.
WIDTH, LOAD, PARTS = 8, 6, 32
#: Rounds of taking out: what is left after them is tried again.
ROUNDS = 10
#: Characters of a bucket of neighbouring documents, about, and buckets at most.
BUCKET, BUCKETS = 1 << 24, 1 << 16
#: A line, or of a long one a part up to a sentence end; without one, up to a word's end or LONG + 200 characters.
PIECE = rf"[^\n]{{{SHORT},{LONG}}}?[.!?]+[ \t]+|[^\n]{{{LONG}}}[^\s]{{0,200}}[ \t]*|[^\n]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order; those of spaces only count, too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def digests(text: Column) -> Column:
    """The set of paragraph digests; repeated paragraphs have several."""

    def numbered(h: Column) -> Column:
        """Of sorted hashes: each with its number among equal ones."""
        starts = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.element_at(h, i) != F.element_at(h, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(s, k + 1), F.size(h) + 1) - at), lambda j: F.xxhash64(F.element_at(h, at), j)))))

    hashes = F.sort_array(F.transform(paragraphs(text), lambda p: F.xxhash64(F.rtrim(p))))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(numbered(h)))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i.cast("int"))


def _hash(key: Column, salt: Column | int) -> Column:
    return F.xxhash64(key, F.lit(salt) if isinstance(salt, int) else salt)


def _check(hashed: Column) -> Column:
    return F.shiftright(hashed, 32).cast("int")


def _mask(hashed: Column) -> Column:
    """One bit for each of the three cells."""
    bits = [_bit(F.shiftrightunsigned(hashed, 5 * j).bitwiseAND(F.lit(WIDTH - 1)) + j * WIDTH) for j in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _empty() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))


def sketch(keys: Column, salt: Column | int = 0) -> Column:
    """Cells of a set of digests."""
    entries = F.transform(keys, lambda k: let(_hash(k, salt), lambda h: F.struct(k.alias("k"), _check(h).alias("c"), _mask(h).alias("m"))))
    add = lambda x, e: _cell(x["n"] + 1, x["k"].bitwiseXOR(e["k"]), x["c"].bitwiseXOR(e["c"]))
    return let(entries, lambda es: F.transform(F.sequence(F.lit(0), F.lit(3 * WIDTH - 1)), lambda i: F.aggregate(F.filter(es, lambda e: e["m"].bitwiseAND(_bit(i)) != 0), _empty(), add)))


def subtract(a: Column, b: Column) -> Column:
    """Cells of what only a has (number above 0) and only b has (below 0)."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, salt: Column | int = 0) -> Column:
    """struct<ok, left, right> of subtracted cells: whether all is recovered, and the digests of either side."""
    none = F.array().cast("array<bigint>")

    def pure(xs: Column) -> Column:
        alone = F.filter(xs, lambda x: F.when(F.abs(x["n"]) == 1, _check(_hash(x["k"], salt)) == x["c"]).otherwise(False))
        return F.array_distinct(F.transform(alone, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), _mask(_hash(x["k"], salt)).alias("m"))))

    def without(xs: Column, ps: Column) -> Column:
        take = lambda x, p: _cell(x["n"] - p["n"], x["k"].bitwiseXOR(p["k"]), x["c"].bitwiseXOR(p["c"]))
        return F.transform(xs, lambda x, i: F.aggregate(F.filter(ps, lambda p: p["m"].bitwiseAND(_bit(i)) != 0), x, take))

    def state(xs: Column, left: Column, right: Column) -> Column:
        return F.struct(xs.alias("cells"), left.alias("left"), right.alias("right"))

    def side(ps: Column, sign: int) -> Column:
        return F.transform(F.filter(ps, lambda p: p["n"] == sign), lambda p: p["k"])

    def step(s: Column, _: Column) -> Column:
        return let(pure(s["cells"]), lambda ps: F.when(F.size(ps) == 0, s).otherwise(state(without(s["cells"], ps), F.concat(s["left"], side(ps, 1)), F.concat(s["right"], side(ps, -1)))))

    def done(s: Column) -> Column:
        rest = F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
        return F.struct((~rest).alias("ok"), s["left"].alias("left"), s["right"].alias("right"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none), step, done)


def pack(cells: Column) -> Column:
    """Cells as bytes: of each the number (4), the digests (8) and the checks (4)."""
    wide = lambda x, n: F.lpad(F.hex(x), n, "0")
    low = lambda x: x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.unhex(F.array_join(F.transform(cells, lambda x: F.concat(wide(low(x["n"]), 8), wide(x["k"], 16), wide(low(x["c"]), 8))), ""))


def unpack(packed: Column) -> Column:
    """The cells of packed bytes."""
    number = lambda x: F.conv(x, 16, -10)

    def signed(x: Column, bits: int) -> Column:
        wide = number(x).cast("decimal(20,0)")
        return F.when(wide >= F.lit(1 << (bits - 1)), wide - F.lit(1 << bits)).otherwise(wide)

    def cell(text: Column) -> Column:
        return _cell(signed(F.substring(text, 1, 8), 32).cast("int"), F.conv(F.substring(text, 9, 16), 16, -10).cast("long"), signed(F.substring(text, 25, 8), 32).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(3 * WIDTH - 1)), lambda i: let(F.hex(F.substr(packed, i * 16 + 1, F.lit(16))), cell))


def fingerprint(cells: Column) -> Column:
    return F.base64(pack(cells))


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """Shared digests by all, of the numbers of digests of either side and of those that differ."""
    return F.when(left + right == 0, 1.0).otherwise((left + right - differing) / (left + right + differing))


def reconcile(pairs: DataFrame, recovered: bool = True) -> DataFrame:
    """The differing digests of pairs (pid, left, right), by ever larger sketches until all are recovered.

    One or more rows a pair, each with the digests of one part: (pid, left, right) or, unless ``recovered``, (pid, n) with their number.
    """
    todo, level, out = stash(pairs.select("pid", "left", "right"), "pairs"), 0, []
    while True:
        level += 1
        n = F.size("left") + F.size("right")
        parts = F.least(F.greatest(F.ceil(n / F.lit(LOAD)), F.lit(2)), F.lit(PARTS)).cast("int")
        mine = lambda keys: F.filter(keys, lambda k: F.pmod(_hash(k, -level), F.col("parts").cast("long")) == F.col("part"))  # noqa: E731, B023
        dealt = todo.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("pid", mine("left").alias("left"), mine("right").alias("right"))
        got = F.when(F.size("left") + F.size("right") <= 4 * LOAD, peel(subtract(sketch(F.col("left"), level), sketch(F.col("right"), level)), level))
        tried = dealt.where(F.size("left") + F.size("right") > 0).withColumn("got", got)
        ok = F.coalesce(F.col("got.ok"), F.lit(False))
        kept = [F.when(ok, F.col("got.left")).alias("a"), F.when(ok, F.col("got.right")).alias("b")] if recovered else [F.when(ok, F.size("got.left") + F.size("got.right")).alias("n")]
        done = stash(tried.select("pid", ok.alias("ok"), *kept, F.when(~ok, F.col("left")).alias("left"), F.when(~ok, F.col("right")).alias("right")), "parts")
        out.append(done.where("ok").select("pid", *([F.col("a").alias("left"), F.col("b").alias("right")] if recovered else ["n"])))
        todo = done.where("NOT ok").select("pid", "left", "right")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, out)


def _buckets(df: DataFrame) -> str:
    """JSON of the first (doc_id, hash) of each bucket of neighbours, in order; df has doc_id, text, h."""
    spark = df.sparkSession
    chars = df.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(min(BUCKETS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET)))
    low = df.select("doc_id", "h").repartitionByRange(n, F.asc_nulls_first("doc_id"), "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("m"))
    rows = [(r["m"]["doc_id"], r["m"]["h"]) for r in low.collect()]
    return json.dumps([{"doc_id": d, "h": h} for d, h in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))])


def with_next(docs: DataFrame, extra: Callable[[], dict[str, Column]] = dict) -> DataFrame:
    """(doc_id, text) of all documents and ``extra`` columns of the text, with ``next``: a struct of the same of the next document.

    One shuffle of the texts, by buckets of neighbouring documents; the first document of a bucket is a guest in the one
    before it, so that its last document has its next one there.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    starts = F.from_json(F.lit(_buckets(own)), "array<struct<doc_id:bigint,h:bigint>>")
    me = F.struct("doc_id", "h")

    def search(s: Column, _: Column) -> Column:
        """The last start that is not above the row lies in [low, high)."""
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.when(F.get(starts, middle) <= me, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high"))))

    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(BUCKETS.bit_length())), F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), search, lambda s: s["low"])
    here = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.size(starts)).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    at = F.when(F.get(starts, F.col("bucket")) == me, F.array(here, before)).otherwise(F.array(here))
    dealt = own.withColumn("bucket", bucket).withColumn("at", F.explode(at)).select("at.bucket", "at.guest", "doc_id", "h", "text").repartition("bucket")
    columns = extra()
    computed = dealt.select("bucket", "guest", "doc_id", "h", "text", *(c.alias(k) for k, c in columns.items()))
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("doc_id"), "h")
    return computed.withColumn("next", F.lead(F.struct("text", *columns)).over(order)).where(~F.col("guest")).select("doc_id", "text", *columns, "next")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 4) characters replaced by the first as many of another."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(following, F.lit(1), cut))


def versions(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the numbers of differing digests.
    """
    first = with_next(docs, lambda: {"keys": digests(F.col("text"))})
    both = first.select("doc_id", F.length("text").cast("long").alias("n_chars"), "keys", edited(F.col("text"), F.col("next.text")).alias("changed"), F.col("next.keys").alias("after"))
    cells = both.select("doc_id", "n_chars", "keys", "after", F.sha2("changed", 256).alias("edited_sha256"), digests(F.col("changed")).alias("changed"))
    cells = cells.select("*", sketch(F.col("keys")).alias("own"), sketch(F.col("changed")).alias("other"), sketch(F.col("after")).alias("following"))
    tried = cells.select("*", peel(subtract(F.col("own"), F.col("other"))).alias("to_edited"), peel(subtract(F.col("own"), F.col("following"))).alias("to_next"))
    differ = lambda x: F.when(F.col(f"{x}.ok"), F.size(f"{x}.left") + F.size(f"{x}.right"))
    open_ = lambda x, c: F.when(~F.col(f"{x}.ok"), F.col(c))
    main = stash(tried.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", "edited_sha256", pack(F.col("own")).alias("own"), pack(F.col("other")).alias("other"),
        F.size("keys").alias("n_own"), F.size("changed").alias("n_edited"), F.size("after").alias("n_next"), differ("to_edited").alias("d_edited"), differ("to_next").alias("d_next"),
        F.when(~F.col("to_edited.ok") | ~F.col("to_next.ok"), F.col("keys")).alias("left"), open_("to_edited", "changed").alias("changed"), open_("to_next", "after").alias("after"),
    ), "sketches")
    rights = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("which"), F.col("changed").alias("right")), F.struct(F.lit(1).cast("long").alias("which"), F.col("after").alias("right"))), lambda r: r["right"].isNotNull())
    pairs = main.select("uid", "left", F.explode(rights).alias("r")).select((F.col("uid") * 2 + F.col("r.which")).alias("pid"), "left", "r.right")
    found = reconcile(pairs, recovered=False)
    sums = found.groupBy(F.shiftright("pid", 1).alias("uid")).agg(*(F.sum(F.when(F.col("pid").bitwiseAND(F.lit(1)) == i, F.col("n"))).alias(c) for i, c in enumerate(("more_edited", "more_next"))))
    whole = beside(main.drop("left", "changed", "after"), sums, "uid", main.count(), "uid", "left")
    d = {x: F.coalesce(F.col(f"d_{x}").cast("long"), F.col(f"more_{x}"), F.lit(0).cast("long")) for x in ("edited", "next")}
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", F.base64("own").alias("fingerprint"), F.base64("other").alias("edited_fingerprint"),
        *(likeness(F.col("n_own"), F.col(f"n_{x}"), d[x]).alias(f"near_{x}") for x in d), *(d[x].alias(f"n_differ_{x}") for x in d),
    )
