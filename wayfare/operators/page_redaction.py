"""Redaction of a page as a whole: what is personal is replaced alike everywhere on it, and anew on the next page.

Items are rows (page, item, x, y, text), item numbers in reading order. Names are words found by a title, a greeting or a label, in
an item or just after it; ten-digit numbers are taken where they stand. Each page numbers its names and its numbers in the order of first
appearance. An e-mail address that is split over up to three neighbouring items is put together, and the stand-in is cut at the
same places. Everything else is left to the rules of ``redact``.

Every step is a join or an aggregate by page and item, or by page and word: a page of any size is spread over tasks. Null texts are
empty; a null page is a page of its own; items of one number on one page are taken together as one text each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import rank_within

# -- fixed values ------------------------------------------------------------------------------------------------
TITLES = ("mr", "mrs", "ms", "miss", "mstr", "master", "dr", "prof")
GREETINGS = ("dear", "hi", "hello")
LABELS = ("customer name", "guest name", "passenger name", "traveller name", "primary name", "lead name")
NO_NAMES = (
    "name", "age", "gender", "status", "booking", "current", "passenger", "guest", "details", "adult", "child", "infant", "male", "female", "senior", "cnf", "rac", "wl", "sr",
    "no", "of", "on", "to", "in", "at", "the", "and", "for", "per", "km", "hrs", *TITLES, *GREETINGS,
)
STAND_INS = ("SAMPLE", "TRAVELLER", "PERSON", "GUEST")
EMAIL, ADDRESS = "traveller@example.com", r"^[\w.*-]+@[\w.-]+\.\w{2,}$"
FIRST_NUMBER, STEP = 1234567890, 111111
# ----------------------------------------------------------------------------------------------------------------

#: Items that a name may stand in after its title or label; distance of one line, of a wrapped one, and of a column.
AHEAD, SAME_LINE, WRAPPED, COLUMN = 3, 4, 20, 2


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))


def _led(text: Column, leads: tuple[str, ...], many: bool) -> Column:
    """The words after a lead: up to four that look like a name; null where there is no lead."""
    some = "|".join(x.replace(" ", r"\s+") for x in leads)
    rest = F.regexp_extract(text, rf"(?i)(?:^|[^A-Za-z])(?:{some})(?:[.:,]|\b)\s*(.*)$", 1)
    return F.when(text.rlike(rf"(?i)(?:^|[^A-Za-z])(?:{some})(?:[.:,]|\b)"), F.slice(_words(F.regexp_extract(rest, r"^((?:[A-Z][A-Za-z]+[ ]*){1,4})", 1)), 1, 4 if many else 1))


def names(items: DataFrame) -> DataFrame:
    """(page, word, item): words of names, in capitals, with the first item that tells."""
    own = items.select("page", "item", "y", F.coalesce("text", F.lit("")).alias("text"))
    inside = F.flatten(F.array_compact(F.array(_led(F.col("text"), TITLES, True), _led(F.col("text"), GREETINGS, True), _led(F.col("text"), LABELS, True))))
    here = own.select("page", "item", F.explode(inside).alias("word"))
    # a title or label that is an item of its own speaks for the next ones on its line
    alone = "|".join(x.replace(" ", r"\s+") for x in (*TITLES, *LABELS))
    asks = own.where(F.col("text").rlike(rf"(?i)^\s*(?:{alone})\s*[.:]?\s*$")).select("page", F.col("item").alias("lead"), F.col("y").alias("lead_y"), F.explode(F.sequence(F.lit(1), F.lit(AHEAD))).alias("k"))
    asked = asks.select("page", (F.col("lead") + F.col("k")).alias("item"), "lead", "lead_y")
    near = asked.alias("a").join(own.alias("b"), F.col("a.page").eqNullSafe(F.col("b.page")) & (F.col("a.item") == F.col("b.item"))).where(F.abs(F.col("a.lead_y") - F.col("b.y")) <= SAME_LINE)
    after = near.select(F.col("b.page").alias("page"), F.col("a.lead").alias("item"), F.explode(_words(F.col("b.text"))).alias("word")).where(F.col("word").rlike("^[A-Z]{2,}$"))
    found = here.unionByName(after).where((F.length("word") >= 2) & ~F.lower("word").isin(*NO_NAMES))
    return found.groupBy("page", F.upper("word").alias("word")).agg(F.min("item").alias("item"))


def numbers(items: DataFrame) -> DataFrame:
    """(page, word, item, place): ten-digit numbers with where they first stand."""
    each = items.select("page", "item", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![0-9A-Za-z_])[0-9]{10}(?![0-9A-Za-z_])"), F.lit(0))).alias("place", "word"))
    return each.groupBy("page", "word").agg(F.min(F.struct("item", "place")).alias("f")).select("page", "word", "f.item", "f.place")


def stand_ins(items: DataFrame) -> DataFrame:
    """(page, word, stand_in) of all names and numbers of all pages."""
    ranked = rank_within(names(items).select("page", "item", "word"), ["page"], ["item", "word"])
    n, k = F.lit(len(STAND_INS)), F.col("rank") - 1
    name = F.concat(F.element_at(F.array(*(F.lit(x) for x in STAND_INS)), (k % n + 1).cast("int")), F.when(k >= n, k.cast("string")).otherwise(""))
    counted = rank_within(numbers(items).select("page", "item", "place", "word"), ["page"], ["item", "place", "word"])
    number = F.lpad((F.lit(FIRST_NUMBER) + (F.col("rank") - 1) * STEP).cast("string"), 10, "0")
    return ranked.select("page", "word", name.alias("stand_in")).unionByName(counted.select("page", "word", number.alias("stand_in")))


def split_addresses(items: DataFrame) -> DataFrame:
    """(page, item, fragment): what an item of a split e-mail address becomes."""
    own = items.select("page", "item", "x", "y", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    start = own.where(F.col("text").contains("@") & ~F.col("text").rlike(ADDRESS)).select("page", F.col("item").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    asked = start.select("page", (F.col("first") + F.col("k")).alias("item"), "first", "k")
    met = asked.alias("a").join(own.alias("b"), F.col("a.page").eqNullSafe(F.col("b.page")) & (F.col("a.item") == F.col("b.item")))
    # three rows for each address that may be split
    three = met.groupBy(F.col("a.page").alias("page"), "a.first").agg(F.array_sort(F.collect_list(F.struct("a.k", "b.text", "b.x", "b.y"))).alias("p"))
    part = lambda k: F.get("p", F.lit(k))
    beside = lambda k: (F.abs(part(k)["y"] - part(0)["y"]) <= SAME_LINE) | ((part(k)["y"] > part(0)["y"]) & (part(k)["y"] - part(0)["y"] <= WRAPPED) & (F.abs(part(k)["x"] - part(0)["x"]) <= COLUMN))
    two, all_three = F.concat(part(0)["text"], part(1)["text"]), F.concat(part(0)["text"], part(1)["text"], part(2)["text"])
    n = F.when((part(1)["k"] == 1) & beside(1), F.when(two.rlike(ADDRESS), 2).when((part(2)["k"] == 2) & beside(2) & all_three.rlike(ADDRESS), 3))
    whole = three.withColumn("n", n).where("n IS NOT NULL")
    sizes = F.transform(F.slice("p", F.lit(1), F.col("n")), lambda x: F.length(x["text"]))
    total = lambda upto: F.aggregate(F.slice("sizes", F.lit(1), upto), F.lit(0), lambda a, b: a + b)
    cut = lambda k: F.when(k == F.col("n"), len(EMAIL)).otherwise(F.round(total(k) / total(F.col("n")) * len(EMAIL)).cast("int"))
    each = whole.withColumn("sizes", sizes).select("page", "first", "n", "sizes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return each.select("page", (F.col("first") + F.col("k")).alias("item"), F.substr(F.lit(EMAIL), cut(F.col("k")) + 1, cut(F.col("k") + 1) - cut(F.col("k"))).alias("fragment")).groupBy("page", "item").agg(F.min("fragment").alias("fragment"))


def redact_pages(items: DataFrame) -> DataFrame:
    """items with their text replaced."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    used = items.select("page", "item", F.explode(F.array_distinct(F.transform(words, F.upper))).alias("word"))
    swaps = used.alias("u").join(stand_ins(items).alias("s"), F.col("u.page").eqNullSafe(F.col("s.page")) & (F.col("u.word") == F.col("s.word"))).select(F.col("u.page").alias("page"), "u.item", F.struct("u.word", "s.stand_in").alias("swap"))
    # the words of one item only
    own = swaps.groupBy("page", "item").agg(F.map_from_entries(F.collect_set("swap")).alias("swaps"))
    parts = split_addresses(items)
    match = lambda a, b: F.col(f"{a}.page").eqNullSafe(F.col(f"{b}.page")) & (F.col(f"{a}.item") == F.col(f"{b}.item"))
    joined = items.alias("i").join(own.alias("o"), match("i", "o"), "left").join(parts.alias("p"), match("i", "p"), "left")
    pieces = F.regexp_extract_all(F.col("i.text"), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    # short names only as written: "MS" is not "ms"
    swapped = F.array_join(F.transform(pieces, lambda w: F.when((F.length(w) >= 4) | (w == F.upper(w)), F.coalesce(F.try_element_at("swaps", F.upper(w)), w)).otherwise(w)), "")
    text = F.when(F.col("fragment").isNotNull(), F.col("fragment")).when(F.col("swaps").isNotNull(), swapped).otherwise(F.col("i.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"i.{c}").alias(c) for c in items.columns))


def without_initials(text: Column) -> Column:
    """A lone initial beside a stand-in goes."""
    return reduce(lambda t, s: F.regexp_replace(t, rf"\b({s}[0-9]*)\s+[A-Z]\b(?!\w)", "$1"), STAND_INS, text)
