"""Known codes in running text: tokens against a table of codes, as joins.

A three-letter word is a code only if the table has it. A line that has exactly two different known codes is a route, in
reading order, and the first such line of a document counts. Names that are wholly a city of the table are no persons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places


def line_tokens(lines: DataFrame, doc: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """(doc, line, position, code): words of three letters, in capitals, of each line."""
    words = F.regexp_extract_all(F.upper(F.col(text)), F.lit(r"(?<![A-Z0-9_])[A-Z]{3}(?![A-Z0-9_])"), F.lit(0))
    return lines.select(doc, line, F.posexplode(words).alias("position", "code"))


def known_tokens(lines: DataFrame, table: DataFrame | None = None, doc: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """The tokens that are codes of the table (code, city, zone); a small table is broadcast."""
    return places.known_airports(line_tokens(lines, doc, line, text), "code", table)


def routes(lines: DataFrame, table: DataFrame | None = None, doc: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """(doc, origin, destination, line) of documents in which some line holds exactly two known codes.

    A code that repeats in a line counts once, where it stands first. Counts and firsts are partial aggregates, so a long
    document or line is not gathered; documents without such a line are left out.
    """
    each = known_tokens(lines, table, doc, line, text).groupBy(doc, line, "code").agg(F.min("position").alias("position"))
    by_line = each.groupBy(doc, line).agg(F.count("*").alias("n"), F.min_by("code", "position").alias("origin"), F.max_by("code", "position").alias("destination"))
    first = by_line.where("n = 2").groupBy(doc).agg(F.min_by(F.struct("origin", "destination", F.col(line).alias("line")), F.col(line)).alias("r"))
    return first.select(doc, "r.origin", "r.destination", "r.line")


def persons(names: DataFrame, name: str, table: DataFrame | None = None) -> DataFrame:
    """The rows whose name is not a whole city of the table."""
    cities = (table if table is not None else places.airports(names.sparkSession)).select(F.lower("city").alias("_city")).where(F.length("_city") >= 3).distinct()
    return names.join(places._small(cities), F.lower(F.trim(F.col(name))) == F.col("_city"), "left_anti")
