import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.functions import scalars, seats
from wayfare.operators.builders import date_of, time_of


def column(spark, values, fn, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).coalesce(1).select(fn(F.col("v"))).collect()]


def test_times(spark):
    texts = ["Dep 09:05", "7.30 pm", "12:00 am", "1430 hrs", "9 pm", "25:10", "no time", None, "12:61", "02:34:15 PM", "0700 am", "700 hrs", "16h40", "01-Jun-2025 16:40", "at 9 45 p.m."]
    want = ["09:05", "19:30", "00:00", "14:30", None, None, None, None, None, "14:34", "07:00", "07:00", "16:40", "16:40", "21:45"]
    assert column(spark, texts, scalars.parse_time) == want
    assert [time_of(t) for t in texts] == want


def test_dates(spark):
    ref = F.lit("1999-06-15").cast("date")
    texts = ["on 2024-02-03", "3rd Feb 2024", "30 Feb 2023", "March 5, 2021", "25/12/24", "12/25/2024", "05/06/2024", "4 Jul", "nothing", None, "31/31/2020"]
    want = ["2024-02-03", "2024-02-03", "2023-03-02", "2021-03-05", "2024-12-25", "2024-12-25", None, "1999-07-04", None, None, None]
    got = column(spark, texts, lambda c: scalars.parse_date(c, ref))
    assert [r["date"] and r["date"].isoformat() for r in got] == want
    assert [r["ambiguous"] for r in got] == [t in ("05/06/2024", "31/31/2020") for t in texts]
    assert [r["had_year"] for r in got][7] is False
    assert len(got[6]["candidates"]) == 2
    assert [date_of(t, dt.date(1999, 6, 15))[0] for t in texts] == want


def test_julian(spark):
    rows = spark.createDataFrame([(1, "2023-12-30"), (366, "2023-06-01"), (366, "2024-12-01"), (200, "2024-07-01"), (None, "2024-01-01"), (400, "2024-01-01")], "d int, r string")
    got = rows.select(scalars.resolve_julian(F.col("d"), F.col("r").cast("date")).alias("j")).collect()
    assert [(str(r.j["date"]), r.j["confidence"]) for r in got] == [("2024-01-01", "high"), ("2024-12-31", "low"), ("2024-12-31", "high"), ("2024-07-18", "high"), ("None", None), ("None", None)]


def test_offsets_follow_daylight_saving(spark):
    rows = spark.createDataFrame([("2024-07-01 12:00:00", "Europe/London"), ("2024-01-01 12:00:00", "Europe/London"), ("2024-01-01 12:00:00", "Asia/Kolkata")], "t string, z string")
    assert [r[0] for r in rows.select(scalars.offset_minutes(F.col("t").cast("timestamp"), F.col("z"))).collect()] == [60, 0, 330]
    w = rows.select(scalars.wallet_date(F.lit("2024-07-01").cast("date"), F.lit("09:30"), scalars.offset_minutes(F.col("t").cast("timestamp"), F.col("z"))))
    assert [r[0] for r in w.collect()] == ["2024-07-01T09:30:00+01:00", "2024-07-01T09:30:00+00:00", "2024-07-01T09:30:00+05:30"]


@pytest.mark.parametrize(
    ("fn", "texts", "want"),
    [
        (scalars.normalise_flight_number, ["0123", "00045A", "x", None], ["123", "45A", None, None]),
        (scalars.normalise_seat, ["012C", "INF", "  ", None], ["12C", "Infant", None, None]),
        (scalars.clean_seat, ["seat 12 C", "100A", "0A", None], ["12C", None, None, None]),
        (scalars.clean_terminal, ["Terminal 2", "T3", "A", "departures", None], ["2", "3", "A", None, None]),
        (scalars.airport_code, ["Delhi (DEL)", "BOM", "from DEL now", "Delhi", None], ["DEL", "BOM", "DEL", None, None]),
        (scalars.email_domain, ["write a.b@Mail.Example.com now", "none", None], ["mail.example.com", None, None]),
        (scalars.looks_like_caption, ["Seat No:", "Booking Reference", "Seat 12", "x", None], [True, True, False, False, None]),
    ],
)
def test_normalisers(spark, fn, texts, want):
    assert column(spark, texts, fn) == want


def test_stations_and_senders(spark):
    got = column(spark, ["NEW DELHI (NDLS)", "NDLS - NEW DELHI", "MUMBAI CST - CSTM", "Pune Jn"], scalars.parse_station)
    assert [(r["name"], r["code"]) for r in got] == [("NEW Delhi", "NDLS"), ("NEW Delhi", "NDLS"), ("Mumbai CST", "CSTM"), ("Pune Jn", None)]
    rows = spark.createDataFrame([("Acme Rail", "x.com"), ("noreply", "mail.blue-bus.in"), ("info", "gmail.com"), (None, None), ('Acme via Mailer', None)], "n string, d string")
    assert [r[0] for r in rows.select(scalars.provider_from_sender(F.col("n"), F.col("d"))).collect()] == ["Acme Rail", "Blue-bus", None, None, "Acme"]


def test_messages_are_known(spark):
    texts = ["From: a\nSubject: b\n\nx", "Hello\nFrom: a\nTo: b\n", "From me Mon\nx", "plain", None]
    assert column(spark, texts, scalars.looks_like_message) == [True, False, True, False, False]


def test_hash_matches_its_definition(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >> 31 else h)

    texts = ["", "a", "Indigo", "x" * 50]
    assert column(spark, texts, scalars.fnv_hash) == [fnv(t) for t in texts]


def test_contrast(spark):
    got = spark.createDataFrame([(0,), (0xFFFFFF,), (0xFFFF00,)], "v int").select(F.round(scalars.contrast(F.col("v"), F.lit(0xFFFFFF)), 2), scalars.contrast(scalars.ensure_readable(F.col("v")), F.lit(0xFFFFFF)) >= 4.5).collect()
    assert [r[0] for r in got] == [21.0, 1.0, 1.07]
    assert all(r[1] for r in got)


@given(st.lists(st.integers(1, 60), min_size=1, max_size=12, unique=True))
def test_seats_of_a_written_list(numbers):
    assert seats.parse(", ".join(f"B{n}" for n in numbers)) == [f"B{n}" for n in numbers]


def test_seat_lists():
    assert seats.parse("Seats: A1-A4, B2") == ["A1", "A2", "A3", "A4", "B2"]
    assert seats.parse("H5, 6, 7") == ["H5", "H6", "H7"]
    assert seats.parse("A1-B9") == ["A1-B9"]
    assert seats.parse("A1 & A1") == ["A1"]
    assert seats.parse(None) == [] == seats.parse("")


def test_seat_runs(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 5, 7, 8)] + [("b", n) for n in range(1, 40, 2)] + [("c", None)], "k string, n int")
    got = {r.k: (r.n, r.summary) for r in seats.runs(rows, ["k"], "n").collect()}
    assert got == {"a": (6, "1–3, 5, 7, 8"), "b": (20, "20 seats")}


def test_coach_and_berth(spark):
    got = column(spark, ["CNF / B2 / 34 / LB", "S4, 12, SIDE UPPER", "WL 12"], seats.parse_coach_berth)
    assert [tuple(r) for r in got] == [("CNF", "B2", "34", "Lower"), (None, "S4", "12", "Side Upper"), (None, None, None, None)]
