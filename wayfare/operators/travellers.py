"""Lists of names: repeats and longer forms of a name that is there already are one traveller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_names(names: DataFrame, doc: str = "doc_id", position: str = "position", name: str = "name") -> DataFrame:
    """(doc, name, position): names of which none is another one plus more words, as they are first written, at the place of the first of all
    names that they stand for.

    Names are compared without regard to case and to the width of gaps; blank and null ones are left out. Every name asks for
    each of its beginnings, so that shared beginnings meet in a join by document and name: a list of any length is not
    gathered, and no name is compared with all others.
    """
    key = F.upper(F.trim(F.regexp_replace(name, r"\s+", " ")))
    each = names.select(doc, position, F.trim(F.regexp_replace(name, r"\s+", " ")).alias("name"), key.alias("key")).where("key <> ''")
    own = each.groupBy(doc, "key").agg(F.min(F.struct(F.col(position).alias("position"), "name")).alias("first"))
    words = F.split("key", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    asked = own.select(F.col(doc).alias("_doc"), F.col("key").alias("long"), F.col("first.position").alias("position"), F.explode(starts).alias("start"))
    have = own.select(F.col(doc).alias("_own"), F.col("key").alias("short"), F.col("first.name").alias("name"))
    met = asked.join(have, F.col("_doc").eqNullSafe(F.col("_own")) & (F.col("start") == F.col("short")))
    # the shortest beginning that is a name of the list stands for the longer ones
    root = met.groupBy("_doc", "long").agg(F.min_by(F.struct("short", "name"), F.length("short")).alias("r"), F.min("position").alias("position"))
    return root.groupBy(F.col("_doc").alias(doc), "r.short").agg(F.min("r.name").alias("name"), F.min("position").alias("position")).select(doc, F.col("name").alias(name), F.col("position").alias(position))
