"""Page layout on rows: items to lines and cells by windows, for pages of any number of items.

Items are rows (page, item, text, x, y, width, height), item numbers total within a page. Where a page is one array and small, ``layout``
does the same in one pass; here lines are islands of centres and cells islands of gaps. Items are shuffled once, by page, and sorted there for
lines and again for cells; pages of more than ``ranks.LARGE`` items are dealt over several tasks.
A line ends where the next centre lies more than ``SAME_LINE`` of the page's median height below; a cell where the gap to all before it
is wider than ``CELL_GAP`` of the line's median height. Blank and null texts are left out, as are items without a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import CELL_GAP, SAME_LINE
from .ranks import by_size, islands_dealt, islands_sorted


def with_lines(items: DataFrame) -> DataFrame:
    """items with ``line``: its number on the page, from 0 at the top."""
    own = items.where((F.trim("text") != "") & F.col("y").isNotNull() & F.col("height").isNotNull() & F.col("x").isNotNull() & F.col("width").isNotNull())
    centred = own.withColumn("centre", F.col("y") + F.col("height") / 2)
    how = (["page"], ["centre", "x", "item"], "centre", "near", "line")
    small, large = by_size(centred, ["page"])
    lines = islands_sorted(small.withColumn("near", F.median("height").over(Window.partitionBy("page")) * SAME_LINE), *how)
    if large is not None:
        near = large.groupBy(F.col("page").alias("_page")).agg((F.median("height") * SAME_LINE).alias("near"))
        lines = lines.unionByName(islands_dealt(large.join(near, F.col("page").eqNullSafe(F.col("_page"))).drop("_page"), *how))
    return lines.drop("near", "centre")


def with_cells(items: DataFrame) -> DataFrame:
    """items of ``with_lines`` with ``cell``: its number in the line, from 0 at the left."""
    line = Window.partitionBy("page", "line")
    across = line.orderBy("x", "item")
    limit = F.median("height").over(line) * CELL_GAP
    end = F.max(F.col("x") + F.col("width")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    begun = items.withColumn("_new", F.coalesce((F.col("x") - end > limit).cast("int"), F.lit(0)))
    return begun.withColumn("cell", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def line_boxes(items: DataFrame) -> DataFrame:
    """(page, line, n, cells, x, y, width, height) of the lines of ``with_cells``."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    boxed = items.groupBy("page", "line").agg(F.count("*").alias("n"), (F.max("cell") + 1).alias("cells"), F.min("x").alias("x"), F.min("y").alias("y"), right.alias("_right"), bottom.alias("_bottom"))
    return boxed.select("page", "line", "n", "cells", "x", "y", (F.col("_right") - F.col("x")).alias("width"), (F.col("_bottom") - F.col("y")).alias("height"))


def cell_texts(items: DataFrame) -> DataFrame:
    """(page, line, cell, text): the texts of each cell's items from left to right, a blank between them."""
    words = F.array_sort(F.collect_list(F.struct("x", "item", "text")))
    return items.groupBy("page", "line", "cell").agg(F.array_join(F.transform(words, lambda w: F.trim(w["text"])), " ").alias("text"))
