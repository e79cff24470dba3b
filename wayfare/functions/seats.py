"""Seats: reading lists and ranges, and writing them short."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .udf import on_arrow

_RANGE = re.compile(r"^([A-Z]{0,2})-?(\d{1,3})\s*(?:-|–|to)\s*([A-Z]{0,2})-?(\d{1,3})$")
_ONE = re.compile(r"^([A-Z]{0,2})-?(\d{1,3})([A-Z]?)$")


def parse(text: str | None) -> list[str]:
    """Seats of a list: ranges of fewer than 40 in one row are spelled out, a row letter is inherited."""
    out: list[str] = []
    row = ""
    cleaned = re.sub(r"(?i)\b(?:seats?|nos?\.?|numbers?)\b[:.]?", " ", text or "")
    for token in re.split(r"[,;/&]|\band\b", re.sub(r"\s*(–|-|\bto\b)\s*", "-", cleaned)):
        t = re.sub(r"\s+", "", token.upper())
        if not t:
            continue
        m = _RANGE.match(t)
        if m:
            a, lo, b, hi = m[1] or row, int(m[2]), m[3] or m[1] or row, int(m[4])
            if a == b and 0 < hi - lo < 40:
                out += [f"{a}{n}" for n in range(lo, hi + 1)]
            else:
                out.append(t)
            row = a or row
            continue
        m = _ONE.match(t)
        if m:
            row = m[1] or row
            out.append(f"{m[1] or ('' if m[3] else row)}{int(m[2])}{m[3]}")
        elif re.fullmatch(r"[A-Z0-9-]{1,8}", t):
            out.append(t)
    return list(dict.fromkeys(out))


@on_arrow("array<string>")
def parse_seats(text):
    return parse(text)


def runs(rows: DataFrame, keys: list[str], number: str, most: int = 24) -> DataFrame:
    """(keys, n, summary): numbers of a key as runs; three or more in a row become a range.

    Longer than ``most`` characters, the summary is the count. Gaps and islands over distinct numbers.
    """
    once = rows.select(*keys, F.col(number).cast("int").alias("_n")).where("_n is not null").distinct()
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys).orderBy("_n"))
    spans = once.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    text = F.when(F.col("hi") - F.col("lo") >= 2, F.concat(F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string"))).when(F.col("hi") > F.col("lo"), F.concat(F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"))).otherwise(F.col("lo").cast("string"))
    joined = spans.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"]), ", ").alias("_s"))
    return joined.select(*keys, "n", F.when(F.length("_s") > most, F.concat(F.col("n").cast("string"), F.lit(" seats"))).otherwise(F.col("_s")).alias("summary"))


# -- fixed values: berth codes of Indian railways --------------------------------------------------------------
BERTHS = {"SU": "Side upper", "SL": "Side lower", "SM": "Side middle", "LB": "Lower", "MB": "Middle", "UB": "Upper", "WS": "Window", "LOWER": "Lower", "MIDDLE": "Middle", "UPPER": "Upper"}
# ---------------------------------------------------------------------------------------------------------------


#: Words of a berth's position, longer ones first.
POSITIONS = {"SIDE LOWER": "Side lower", "SIDE UPPER": "Side upper", "SIDE MIDDLE": "Side middle", "WINDOW SIDE": "Window", "LOWER": "Lower", "MIDDLE": "Middle", "UPPER": "Upper"}


def berth(text: str | None) -> dict[str, str | None] | None:
    """coach, number and position of ``CNF / B2 / 34 / LB``, ``S7, 42, LOWER``, ``23 LB`` and the like; null where no berth's number stands.

    As ``parse_coach_berth``, for one text; the coach may be missing.
    """
    t = (text or "").upper()
    position = next((v for k, v in POSITIONS.items() if k in t), None)
    for k in POSITIONS:
        t = t.replace(k, " ")
    coach = number = None
    for token in re.findall(r"[A-Z0-9]+", t):
        if token in BERTHS and not position:
            position = BERTHS[token]
        elif coach is None and number is None and re.fullmatch(r"[A-Z]{1,2}[0-9]{1,2}", token):
            coach = token
        elif number is None and re.fullmatch(r"[0-9]{1,3}", token):
            number = str(int(token))
    return {"coach": coach, "number": number, "position": position} if number and (coach or position) else None


def expand_berth(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in BERTHS.items() for x in kv))[F.upper(F.trim(code))]


def parse_coach_berth(text: Column) -> Column:
    """struct<status, coach, berth, position> of ``CNF / B2 / 34 / LB`` and the like; longest words first."""
    t = F.upper(F.trim(text))
    p = r"^(?:(CNF|RAC|[GRPT]?[NLQ]?WL|WL)\s*[/ -]*)?([A-Z]{1,2}[0-9]{1,2})\s*[/, -]+\s*([0-9]{1,3})(?:\s*[/, -]*\s*(SIDE UPPER|SIDE LOWER|LOWER|MIDDLE|UPPER|SU|SL|SM|LB|MB|UB|WS))?"
    g = lambda k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    return F.struct(g(1).alias("status"), g(2).alias("coach"), g(3).alias("berth"), F.coalesce(expand_berth(g(4)), F.initcap(g(4))).alias("position"))
