"""Quality rules, the record store, classification and barcodes, with hand-stated answers."""

import datetime as dt
import re
import time
from unittest import mock

import pyarrow as pa
from pyspark.sql import functions as F

from wayfare.functions import scalars, udf
from wayfare.operators import barcode, builders, classify, layout, quality, reading, store
from wayfare.plans import lifecycle
from wayfare.schemas import RECORD

H, D = 3_600_000, 86_400_000
NOW = 1_000 * D


def field(spark, value="x", source="pdf-text", **more):
    return spark.range(1).select(quality.new_field("k", F.lit(value).cast("string"), F.lit(source), **more).alias("f"))


def after(df, fn):
    return df.select(fn(F.col("f")).alias("f")).select("f.*", quality.needs_review(F.col("f")).alias("review")).first()


def test_confidence_follows_the_source(spark):
    for source, want in {"barcode": "high", "pdf-text": "medium", "ocr": "low", "inferred": "low", "user": "high"}.items():
        assert after(field(spark, source=source), lambda f: f)["confidence"] == want
    assert after(field(spark, value=" "), lambda f: f)["confidence"] == "missing"


def test_review_rules_in_order(spark):
    assert after(field(spark, critical=True), lambda f: f)["review"] is True
    assert after(field(spark, critical=True), lambda f: quality.corroborate(f, F.lit("ocr")))["review"] is False
    assert after(field(spark, value=None, required=True), lambda f: f)["review"] is True
    assert after(field(spark, value=None, critical=True), lambda f: f)["review"] is False
    assert after(field(spark, source="ocr"), lambda f: f)["review"] is True
    row = after(field(spark, source="barcode", critical=True), lambda f: quality.conflict(f, F.lit("y")))
    assert (row["confidence"], row["review"], row["issues"][0]["code"]) == ("low", True, "conflict")
    assert after(field(spark, source="ocr"), quality.confirm)["review"] is False


def test_changes(spark):
    row = after(field(spark, source="barcode"), lambda f: quality.warn(f, F.lit("odd")))
    assert (row["confidence"], row["issues"][0]["level"]) == ("medium", "warning")
    row = after(field(spark), lambda f: quality.auto_correct(f, F.lit("z")))
    assert (row["value"], row["original_value"], row["confidence"]) == ("z", "x", "medium")
    assert after(field(spark), lambda f: quality.auto_correct(f, F.lit("x")))["issues"] == []
    row = after(field(spark), lambda f: quality.set_by_user(quality.conflict(f, F.lit("q")), F.lit("w")))
    assert (row["source"], row["confidence"], row["edited"], row["issues"]) == ("user", "high", True, [])


def test_dates_are_reconciled(spark):
    def case(printed, had_year=True, ambiguous=False, anchored=False, julian="high"):
        fn = lambda f: quality.reconcile_date(f, F.lit(anchored), F.lit(julian), F.lit(printed).cast("string"), F.lit(had_year), F.lit(ambiguous))
        r = after(field(spark, value="2024-05-01", source="barcode"), fn)
        return r["value"], r["confidence"], [i["code"] for i in r["issues"]]

    assert case(None) == ("2024-05-01", "medium", ["inferred-year"])
    assert case(None, anchored=True) == ("2024-05-01", "high", [])
    assert case("2024-05-01") == ("2024-05-01", "high", [])
    assert case("2025-05-01") == ("2025-05-01", "high", ["auto-corrected"])
    assert case("2024-06-01") == ("2024-05-01", "low", ["inferred-year", "conflict"])


def records(spark, *rows):
    full = [(i, "flight", {}, d, a, None, "t", x) for i, d, a, x in rows]
    return spark.createDataFrame(full, RECORD)


def test_sides_and_next(spark):
    r = records(spark, ("soon", NOW + H, 1, False), ("grace", NOW - 3 * H, 2, False), ("past", NOW - 7 * H, 3, False), ("none", None, 4, False), ("kept", NOW + H, 5, True))
    assert {x.id: x.side for x in store.partition(r, NOW).collect()} == {"soon": "upcoming", "grace": "upcoming", "past": "past", "none": "upcoming", "kept": "past"}
    assert store.next_record(r, NOW).first().id == "none"
    assert store.next_record(r.where("id <> 'none'"), NOW).first().id == "grace"
    assert store.next_record(r.limit(0), NOW).count() == 0
    order = [x.id for x in store.partition(r, NOW).where("side = 'past'").orderBy("sort_key").collect()]
    assert order == ["kept", "past"]


def test_retention(spark):
    r = records(spark, ("a", NOW - 40 * D, 1, False), ("b", NOW - 10 * D, 1, True), ("c", None, 1, False), ("d", NOW - 3 * H, 1, False))
    ids = lambda df: sorted(x.id for x in df.collect())
    assert ids(store.expired(r, NOW, 30)) == ["a"]
    assert ids(store.expired(r, NOW, 7)) == ["a", "b"]
    assert ids(store.expired(r, NOW, None)) == []
    assert ids(store.retain(r, NOW, "at-once")) == ["c", "d"]


def test_backup_round_trip(spark):
    r = records(spark, ("a", 1, 1, False), ("b", 2, 1, False))
    lines = store.export_all(r)
    assert {x.id: x.status for x in store.import_all(r.where("id = 'a'"), lines).collect()} == {"a": "skipped", "b": "added"}
    assert {x.status for x in store.import_all(r, lines, replace=True).collect()} == {"added"}
    twice = spark.createDataFrame([(x.line, k) for k, x in enumerate(store.export_all(records(spark, ("a", 5, 1, False))).union(store.export_all(records(spark, ("a", 6, 1, False)))).collect())], "line string, ord int")
    got = store.import_all(r.limit(0), twice).collect()
    assert [(x.id, x.departs_at) for x in got] == [("a", 6)]
    import pytest

    with pytest.raises(Exception, match="not a backup"):
        store.import_all(r, spark.createDataFrame([('{"format":"x"}',)], "line string")).collect()


def test_upsert_and_archive(spark):
    r = records(spark, ("a", 1, 1, False), ("b", 2, 1, False))
    got = {x.id: x.updated_at for x in store.upsert(r, r.where("id = 'b'"), NOW).collect()}
    assert got == {"a": None, "b": NOW}
    ids = r.where("id = 'a'").select("id")
    assert {x.id: x.archived for x in store.archive(r, ids).collect()} == {"a": True, "b": False}
    assert [x.id for x in store.delete(r, ids).collect()] == ["b"]


TEXTS = {
    "flight": "Boarding pass\nPNR AB12CD\nAirport terminal 2\nGate 4 Seat 12A",
    "rail": "Indian Railways IRCTC\nTrain No 12951 coach B2 berth 34\nQuota GN PNR 123",
    "event": "PVR Cinemas\nScreen 4\nShow time 7:30 pm 12 Jan 2024\nRow F Seat 12",
    "lodging": "Hotel Blue\nCheck-in 1 May\nCheck-out 3 May\n2 nights\nLead guest A B",
    None: "Dear customer, thank you for your payment. Tax invoice attached.",
}


def test_kinds(spark):
    rows = spark.createDataFrame([(k or "none", t, None) for k, t in TEXTS.items()] + [("coded", "x", "M1" + " " * 60), ("blank", "", None), ("code", "hello", "ABC123")], "k string, text string, payload string")
    got = {r.k: (r.kind, r.kind_score) for r in classify.select_kind(rows).collect()}
    assert [got[k or "none"][0] for k in TEXTS] == list(TEXTS)
    assert got["coded"] == ("flight", 100) and got["blank"] == ("generic", 3) and got["code"] == ("generic", 5)


def test_signals_count_wherever_they_stand(spark):
    gap = " filler" * 30
    texts = {
        "AI 123 DELHI\nFLIGHT DETAILS\nAIRPORT T2": ("flight", 45), f"Baggage{gap} check-in{gap} GATE{gap} SEAT{gap} airport": ("flight", 50), "IRCTC\nNew Delhi (NDL) Mumbai (MMC)\nPNR NO 1\ncoach berth": ("flight", 0),
        "Cancellation confirmation\nHotel check-in\ncheck-out 2 nights": ("lodging", 0), "Hotel voucher\nnear the boarding point\ncheck-in\ncheck-out 2 nights": ("lodging", 95), "Hotel 2 nights lead guest": ("lodging", 0),
        "Kuching (KCH)\n" * 2000 + "economy airport": ("flight", 55), "cinema screen 4 baggage": ("event", 0), "BMTC daily pass": ("rail", 85),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r for r in df.select("k", *(c.alias(n) for n, c in classify.scores(F.col("t"), F.lit(None)).items())).collect()}
    assert [got[k][kind] for k, (kind, _) in enumerate(texts.values())] == [score for _, score in texts.values()]


def test_modes_and_categories(spark):
    df = spark.createDataFrame([("Bus ticket boarding point dropping point",), ("Train number 1 coach berth",)], "t string")
    assert [r[0] for r in df.select(classify.ground(F.col("t"))["mode"]).collect()] == ["bus", "rail"]
    df = spark.createDataFrame([("cinema screen 2 showtime",), ("concert",), ("x",)], "t string")
    assert [tuple(r[0]) for r in df.select(classify.event_category(F.col("t"))).collect()] == [("movie", "high"), ("concert", "medium"), ("event", "low")]


BODY = "AB12CD DELBOMAI 0123 145Y012C0045 1"
RECORD_1 = "M1" + "DOE/JANE MRS".ljust(20) + "E" + BODY


def test_boarding_records():
    bare = barcode.decode_one(RECORD_1 + "00")
    assert bare["valid"] and bare["surname"] == "Doe" and bare["given"] == "Jane" and not bare["truncated"]
    leg = bare["legs"][0]
    assert (leg["pnr"], leg["origin"], leg["destination"], leg["carrier"], leg["flight"], leg["julian"], leg["seat"], leg["cabin"]) == ("AB12CD", "DEL", "BOM", "AI", "123", 145, "12C", "Y")
    block = ">" + "6" + "07" + "0WW5123" + "05" + "098AB" + "extra"
    full = barcode.decode_one(RECORD_1 + f"{len(block):02X}" + block + "^164sig")
    assert full["version"] == "6" and full["issue_julian"] == "5123" and full["security"] == "164sig"
    assert full["legs"][0]["items"]["airline_numeric"] == "098" and full["legs"][0]["items"]["airline_use"] == "extra"
    two = barcode.decode_one("M2" + RECORD_1[2:] + "00" + BODY.replace("DELBOM", "BOMGOI") + "00")
    assert [x["destination"] for x in two["legs"]] == ["BOM", "GOI"]
    assert "truncated" in barcode.decode_one("M2" + RECORD_1[2:] + "00")["warnings"]
    for bad in (None, "", "X1", "M", "M1short"):
        assert not barcode.decode_one(bad)["valid"]


def test_native_and_python_decoders_agree(spark):
    df = spark.createDataFrame([(RECORD_1 + "00",), ("nope",), (None,)], "p string").coalesce(1)
    rows = df.select(barcode.mandatory(F.col("p")).alias("m"), barcode.decode(F.col("p")).alias("d")).collect()
    assert rows[0].m["pnr"] == rows[0].d["legs"][0]["pnr"] == "AB12CD"
    assert rows[1].m["pnr"] is None and rows[2].m["pnr"] is None and not rows[1].d["valid"]


def test_ranking_stops_at_a_decisive_barcode(spark):
    rows = [(1, 0, "QRCode", "short"), (1, 1, "PDF417", "M1" + "x" * 58), (1, 2, "PDF417", "M1" + "y" * 98), (1, 0, "QRCode", "short")]
    got = barcode.rank(spark.createDataFrame(rows, "doc_id int, ordinal int, format string, text string")).orderBy("rank").collect()
    assert [(r.ordinal, r.score) for r in got] == [(1, 92), (0, -10)]


def test_railway_record(spark):
    text = "PNR No : 123,\nTrain No : 12951,\nPassenger Name : A B,\nPassenger Name : C D,\nTrain No : 9,\n"
    got = spark.createDataFrame([(text,), ("k : v",), (None,)], "t string").select(barcode.railway_record(F.col("t")).alias("r")).collect()
    assert got[0].r["passengers"] == ["A B", "C D"] and got[0].r["values"] == {"pnr no": "123", "train no": "12951"}
    assert got[1].r is None and got[2].r is None


def test_tiles_cover_a_page(spark):
    t = spark.range(1).select(barcode.tiles(F.lit(1200), F.lit(900))).first()[0]
    assert len(t) == 9 and (t[0]["row"], t[0]["column"], t[0]["priority"]) == (2, 2, 0)
    assert max(x["x"] + x["width"] for x in t) == 1200 and max(x["y"] + x["height"] for x in t) == 900


def test_undo_headers_and_resumption(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "id string, departs_at long").withColumn("archived", F.lit(False))
    gone = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "id string")
    left, kept = store.delete(rows, gone), store.removed(rows, gone)
    assert sorted(r.id for r in left.collect()) == ["c"] and sorted(r.id for r in kept.collect()) == ["a", "b"]
    assert sorted((r.id, r.departs_at) for r in store.restore(left, kept).collect()) == [("a", 1), ("b", None), ("c", 3)]
    assert store.restore(rows, kept).count() == 3
    assert store.past_count(rows, 10 * store.DAY).first().n == 2 and store.past_count(rows.limit(0), 0).first().n == 0
    assert store.backup_header(rows, 0, gone).first().line == '{"format":"wayfare-backup-1","exportedAt":"1970-01-01T00:00:00Z","count":2}'
    states = spark.createDataFrame([("a", 0), ("b", 5 * 60_000), ("c", 10**9)], "id string, saved_at long")
    assert [r.id for r in store.resumed(rows, states, 31 * 60_000).collect()] == ["b"]


def test_shapes_dates_and_names(spark):
    df = spark.createDataFrame([(100, 100), (400, 100), (79, 79), (100, 60), (0, 0)], "w int, h int")
    assert [r[0] for r in df.select(barcode.shape_score(df.w, df.h)).collect()] == [100.0, 60.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("2024-05-05", "RAJASTHAN STATE"), ("soon", "KSRTC"), (None, None)], "d string, p string")
    assert [tuple(r) for r in df.select(scalars.format_date(df.d), scalars.tidy_provider(df.p)).collect()] == [("5 May", "Rajasthan State"), ("soon", "KSRTC"), ("", None)]


def test_the_stated_change_of_an_id_wins(spark):
    r = records(spark, ("a", 1, 1, False))
    changes = records(spark, ("a", 5, 5, False), ("a", 7, 7, False), ("b", 2, 2, False)).withColumn("n", F.when(F.col("departs_at") == 5, 2).otherwise(1))
    for parts in (1, 4):
        got = {x.id: x.departs_at for x in store.upsert(r, changes.repartition(parts), NOW, order="n").collect()}
        assert got == {"a": 5, "b": 2}
        assert {x.id: x.departs_at for x in store.upsert(r, changes.drop("n").repartition(parts), NOW).collect()} == {"a": 7, "b": 2}


def test_railway_record_of_many_keys_is_no_square(spark):
    """First values in the order of their keys; a payload of 4,000 keys took a square of reads of all its lines."""
    keys = [f"key {k * 7919 % 4001}" for k in range(4001)]
    many = "PNR No.:A1,\nTrain No.:12,\n" + "".join(f"{k}:{n},\n" for n, k in enumerate(keys)) + "key 5:later,\nName:B,\nPassenger Name:A,\nEmpty:,\n"
    rows = spark.createDataFrame([(0, many), (1, "no keys"), (2, None), (3, "Train:1\nName:X")], "k int, t string")
    began = time.perf_counter()
    got = {r.k: r for r in rows.select("k", barcode.railway_record(F.col("t")).alias("r")).withColumn("e", F.map_entries("r.values")).collect()}
    assert time.perf_counter() - began < 30
    assert got[1].r is got[2].r is got[3].r is None and got[0].r.passengers == ["B", "A"]
    assert [tuple(x) for x in got[0].e] == [("pnr no.", "A1"), ("train no.", "12"), *((k, str(n)) for n, k in enumerate(keys))]


def test_labels_that_are_on_no_line_are_looked_for_once():
    class Label:
        def __init__(self, pattern):
            self.pattern, self.seen, self.own = pattern, 0, re.compile(pattern, re.I)

        def search(self, text):
            self.seen += 1
            return self.own.search(text)

    pages = ("Seat\n12A", "Seat: 12A", "a\nFrom: Pune\nto", "date\nof travel", "Seat no / x", "departure date 5", "x seat", "Gate", "")
    labels = (r"\bseat(?: no\.?)?\b(?! ?/)", r"^from\b", r"date of", r"gate$", r"(?<!x )seat", r"depart(?:ure)?\b(?! date)", r"seat(?!\s*12A)", r"[^a]seat", r"to\Z")
    for page in pages:
        lines = [builders._line(t, k) for k, t in enumerate(page.split("\n")) if t.strip()]
        for p in labels:
            assert layout.find_value(layout.Lines(lines), re.compile(p, re.I)) == layout.find_value(lines, re.compile(p, re.I)), (page, p)
    absent = Label(r"\bpnr\b")
    assert layout.find_value(layout.Lines(builders._line(f"line {k}", k) for k in range(400)), absent) is None and absent.seen == 1
    for text in ("a b", " a  b", "a\tb", "  a b c ", "x   y z"):  # cells of plain text as they are worked out
        line = builders._line(text, 3)
        assert layout.split_columns(line) == layout._split(line)


def test_no_pattern_is_compiled_for_each_document():
    def build(k):
        payload = "M1" + "A/B".ljust(20) + "E" + f"{k:06d} " + "DELBOMAI 0123 045Y012A0001 100"
        return {f["key"]: f for f in builders.build("flight", None, f"PNR {k:06d}, (DEL) x1{k:06d}", payload, dt.date(2024, 3, 1))}

    build(1)
    with mock.patch("re._compiler.compile", wraps=re._compiler.compile) as made:
        found = [build(k) for k in range(2, 60)]
    assert made.call_count == 0 and all(f["pnr"]["corroborated_by"] and f["origin"]["corroborated_by"] and not f["destination"]["corroborated_by"] for f in found)
    for value, text, told in (("AB", "xAB AB", True), ("AB", "xAB ABé", False), ("-A", "b-A", True), ("-A", " -A", False), ("A_", "A_", True), ("AB", "", False)):
        assert builders.stands_in(value, text) == told == bool(re.search(rf"\b{re.escape(value)}\b", text))


def test_dates_are_read_only_on_lines_with_times():
    lines = [{"text": t} for t in ("1 Jan 2024", "On 2 Jan 2024 09:05", "no date 10:10", "3 Jan 2024 11:11", "plain")]
    with mock.patch.object(reading, "readings", wraps=reading.readings) as read:
        assert reading.journey_times(lines, "2024-01-02") == ["09:05"] and read.call_count == 3
    assert reading.journey_times(lines, None) == ["09:05", "10:10", "11:11"]


def test_labels_that_are_nowhere_are_told_by_plain_texts():
    lines = layout.Lines([builders._line(t, k) for k, t in enumerate(["Seat: 5", "Ticket no: TKT1"])])
    for p in (r"^from\b", r"boarding (?:at|from|station)", r"depart(?:ure|s)?\b(?! date)", r"date of (?:travel|journey)|(?:travel|flight) date", r"check-?\s?in(?: date)?", r"reservation up ?to"):
        assert not lines.may_say(re.compile(p, re.I)) and layout.find_labelled(lines, [re.compile(p, re.I)]) is None
    assert lines.may_say(re.compile("seat")) and lines.may_say(re.compile("[st]e")) and lines.may_say(re.compile("f r o m", re.X))


def test_needed_texts_are_in_every_match():
    needed = lambda p: layout.needed(re.compile(p, re.I))
    assert needed(r"date of (?:travel|journey)|(?:travel|flight) date") == ("date of ", " date")
    assert [needed(p) for p in (r"a?b", r"\d+|seat", r"(?:std|sta)", r"x{0,2}", r"[a\]]seat")] == [()] * 5
    for p, text in ((r"ticket (?:no\.?|number)", "TİCKET NO"), (r"\bsta\b", "ſTA"), (r"kilo", "Kılo"), (r"coach\s*/\s*seat", "COACH / Seat"), (r"travell?er(?: name)?", "traveler"), (r"check-?\s?in", "CheckIn")):
        assert re.search(p, text, re.I) and any(n in layout.folded(text) for n in needed(p))
        assert layout.find_labelled(layout.Lines([builders._line(f"{text}: 5", 0)]), [re.compile(p, re.I)]) == "5"


def test_results_in_parts_and_maps_column_by_column(spark):
    kind = pa.struct([("passengers", pa.list_(pa.string())), ("values", pa.map_(pa.string(), pa.string()))])
    made = pa.array([None, {"passengers": ["A"], "values": [("a", "b"), ("c", None)]}, {"passengers": None, "values": None}, {"passengers": [], "values": []}], kind)
    for some in (made, made[1:], made[:2], made[1:1], made[:1]):
        assert udf.values(some) == some.to_pylist()
    rows = spark.range(2 * udf.PART_ROWS + 3, numPartitions=1)
    got = rows.select("id", udf.each_row(lambda k: [str(k)] * (k % 3), "array<string>", [F.col("id")]).alias("r")).collect()
    assert all(r.r == [str(r.id)] * (r.id % 3) for r in got) and len(got) == rows.count()


def test_plain_fields_keep_what_they_are(spark):
    docs = [("a", "Boarding pass\nPNR: AB12CD\nFlight no: AI 123\nDEL - BOM\nairport gate seat", None), ("b", "PVR Cinemas\nScreen 4\nShow time 7:30 pm 12 Jan 2024\nRow F Seat 12", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string, payload string").withColumn("reference", F.lit("2024-01-01").cast("date"))
    got = {(r.doc_id, r.field.key): r.field for r in lifecycle.fields(df).collect()}
    pnr = got["a", "pnr"]
    assert (pnr.label, pnr.value, pnr.source, pnr.confidence, pnr.required, pnr.critical, pnr.confirmed, pnr.edited, pnr.issues, pnr.corroborated_by, pnr.original_value) == ("pnr", "AB12CD", "pdf-text", "medium", True, True, False, False, [], None, None)
    assert got["a", "gate"].confidence == "missing" and got["b", "category"].value == "movie" and ("a", "category") not in got
