"""Layout, builders, messages, redaction and rasters, with hand-stated answers."""

import datetime as dt
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayfare.functions import places, seats, udf
from wayfare.operators import builders, layout, raster, reading, redact
from wayfare.plans import lifecycle
from wayfare.sources import mime


def page(*rows, char=5.2, height=10.0):
    return [{"text": t, "x": float(x), "y": float(y), "width": len(t) * char, "height": height} for y, cells in rows for x, t in cells]


def test_lines_and_cells():
    lines = layout.build_lines(page((100, [(40, "Gate"), (200, "Seat")]), (102, [(300, "12A")]), (130, [(40, "4"), (48, "B")])))
    assert [x["text"] for x in lines] == ["Gate Seat 12A", "4 B"]
    assert [c["text"] for c in layout.split_columns(lines[0])] == ["Gate", "Seat", "12A"]
    assert layout.build_lines([]) == [] and layout.build_lines(page((1, [(1, "  ")]))) == []
    assert layout.median([]) == 0 and layout.median([1, 2, 3, 10]) == 2.5


def value(rows, label):
    return layout.find_value(layout.build_lines(page(*rows)), re.compile(label, re.I))


def test_values_of_labels():
    assert value([(10, [(40, "Seat: 12A")])], "seat") == "12A"
    assert value([(10, [(40, "Booking ref:"), (200, "AB12")])], "booking ref") == "AB12"
    assert value([(10, [(40, "Coach"), (200, "Class")]), (26, [(40, "B2"), (200, "3A")])], "class") == "3A"
    assert value([(10, [(40, "Name"), (200, "Ravi Kumar")])], r"\bname\b") == "Ravi Kumar"
    assert value([(10, [(40, "Seat"), (200, "Gate")])], "seat") is None
    assert value([(10, [(40, "GSTIN number 12")])], "number") is None


def test_tables():
    rows = [(100, [(40, "Name"), (200, "Age"), (300, "Status")]), (116, [(40, "A B"), (200, "30"), (300, "CNF/B2/34")]), (132, [(40, "C D"), (200, "31"), (300, "WL 2")]), (300, [(40, "far"), (200, "1"), (300, "x")])]
    got = layout.read_table(layout.build_lines(page(*rows)), {"name": re.compile("name", re.I), "age": re.compile("age", re.I), "status": re.compile("status", re.I)}, min_match=3)
    assert got == [{"name": "A B", "age": "30", "status": "CNF/B2/34"}, {"name": "C D", "age": "31", "status": "WL 2"}]


REF = dt.date(2024, 3, 1)


def built(kind, text, payload=None):
    return {f["key"]: f["value"] for f in builders.build(kind, [], text, payload, REF)}


def test_flight_text_and_record():
    got = built("flight", "Acme Air\nPassenger: Mr Ravi Kumar\nPNR: AB12CD\nFlight: AI 0123\nDEL-BOM\nDeparture date: 5 May 2024\nDeparture time: 09:30\nSeat: 12 C\nGate: 14\nClass: Economy")
    assert (got["flight"], got["pnr"], got["passenger"], got["origin"], got["destination"]) == ("AI 123", "AB12CD", "Ravi Kumar", "DEL", "BOM")
    assert (got["date"], got["departureTime"], got["seat"], got["gate"], got["cabin"]) == ("2024-05-05", "09:30", "12C", "14", "Economy")
    record = "M1" + "DOE/JANE MRS".ljust(20) + "E" + "AB12CD DELBOMAI 0123 145Y012C0045 100"
    got = built("flight", "x", record)
    assert (got["passenger"], got["flight"], got["date"], got["seat"]) == ("Jane Doe", "AI 123", "2024-05-24", "12C")


def test_ground():
    got = built("rail", "Train No: 12951 Rajdhani\nFrom: NEW DELHI (NDLS)\nTo: MUMBAI (MMCT)\nDate of journey: 5 May 2024\nPNR: 1234567890\nBooking status: CNF/B2/34/LB")
    assert (got["origin"], got["destination"], got["date"], got["pnr"], got["coach"], got["seat"], got["berthPosition"]) == ("New Delhi (NDLS)", "Mumbai (MMCT)", "2024-05-05", "1234567890", "B2", "34", "Lower")
    got = built("rail", "Bus ticket\nPune to Nashik\nService no: X1\nBoarding point: Station\nSeat: 5, 6\nTicket no: T12345\nTravel date: 13/05/2024")
    assert (got["origin"], got["destination"], got["boardingPoint"], got["seat"], got["date"]) == ("Pune", "Nashik", "Station", "5, 6", "2024-05-13")


def test_event_and_lodging():
    got = built("event", "Movie: Big Film\nVenue: City Hall\nScreen 4\nSeats: F1-F3\nDate: 12 Jan 2024\nShow time: 7:30 pm\nBooking ID: XY12345")
    assert (got["title"], got["venue"], got["screen"], got["seat"], got["admits"], got["date"], got["time"], got["booking"]) == ("Big Film", "City Hall", "4", "F1, F2, F3", "3", "2024-01-12", "19:30", "XY12345")
    got = built("lodging", "Hotel: Blue Inn\nCheck-in: 1 May 2024 14:00\nCheck-out: 3 May 2024\nLead guest: Asha Rao\nBooking ID: H12345\n2 adults")
    assert (got["property"], got["checkIn"], got["checkInTime"], got["checkOut"], got["nights"], got["guest"], got["reference"], got["party"]) == ("Blue Inn", "2024-05-01", "14:00", "2024-05-03", "2", "Asha Rao", "H12345", "2 adults")


def test_blanks_rather_than_wrong_values():
    got = built("flight", "Passenger: 2 adults\nPNR: 12\nGate: closed soon\nDate: 05/06/2024")
    assert not any(got[k] for k in ("passenger", "pnr", "gate", "date"))
    assert built(None, "x") == {} and built("generic", "", "ab-1234")["reference"] == "AB-1234"


def test_messages():
    raw = "From: \"Acme Rail\" <no-reply@mail.acme.in>\r\nSubject: =?utf-8?Q?Caf=C3=A9?= =?utf-8?B?IHRpY2tldA==?=\r\nContent-Type: multipart/mixed;\r\n boundary=\"b\"\r\n\r\n--b\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>a=3Db=\r\nc</p>\r\n--b\r\nContent-Type: image/png; name=q.png\r\nContent-ID: <i1>\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--b\r\nContent-Disposition: attachment; filename*0=\"ti\"; filename*1=\"cket.pdf\"\r\nContent-Type: application/pdf\r\n\r\n%PDF\r\n--b--\r\n"
    got = mime.parse(raw)
    assert (got["subject"], got["from_name"], got["from_domain"], got["html"]) == ("Café ticket", "Acme Rail", "mail.acme.in", "<p>a=bc</p>")
    assert got["attachments"] == [{"name": "ticket.pdf", "content_type": "application/pdf", "size": 4}]
    assert got["resources"] == [{"key": "i1", "content_type": "image/png", "size": 3}]
    assert mime.parse(None) is None and mime.parse("just text")["text"] is not None
    assert mime.from_base64("%%%") == b"" and mime.quoted_printable("a=zz") == b"a=zz"


def test_sanitising():
    got = mime.sanitise('<p onclick="x()">a<script>alert(1)</script><a href=" javascript:1">b</a><meta http-equiv=refresh content=0><img src="cid:1">&amp;</p>')
    assert got == '<p>a<a>b</a><img src="cid:1">&amp;</p>'
    got = mime.sanitise('<link rel=stylesheet href="http://x/y.css"><noscript><img src="http://t/1.gif"></noscript><textarea>t</textarea><select><option>o</option></select><form><b>f</b></form><p title="javascript: is a word">z')
    assert got == '<textarea>t</textarea><select><option>o</option></select><p title="javascript: is a word">z'


def code_of(*legs, issued=None):
    block = (">6" + "07" + "0WW" + issued + "00") if issued else ""
    return f"M{len(legs)}" + "DOE/JANE MRS".ljust(20) + "E" + "".join(leg + (f"{len(block):02X}" + block if k == 0 and block else "00") for k, leg in enumerate(legs))


LEG_1, LEG_2 = "AB12CD DELBOMAI 0123 145Y012C0045 1", "AB12CD BOMGOIAI 0456 146C001A0045 3"


def test_legs_and_tables_of_a_record():
    got = built("flight", "x", code_of(LEG_1, LEG_2))
    assert (got["cabin"], got["passengerStatus"]) == ("Economy", "Ticket issuance/passenger checked in")
    assert [got[f"leg2.{k}"] for k in ("origin", "destination", "flight", "date", "seat")] == ["BOM", "GOI", "AI 456", "2024-05-25", "1A"]


def test_issue_dates_fix_the_year():
    assert builders.issue_year("4140", 145, REF) == 2024 and builders.issue_year("4360", 10, REF) == 2025 and builders.issue_year("9001", 5, REF) == 2029
    assert builders.issue_year(None, 5, REF) is None and builders.issue_year("4999", 5, REF) is None
    field = {f["key"]: f for f in builders.build("flight", [], "x", code_of(LEG_1, issued="3100"), REF)}["date"]
    assert field["value"] == "2023-05-25" and field["printed"]["anchored"]


def test_records_weigh_printed_dates(spark):
    rows = [
        ("same", "Booking date: 1 Jan 2020\nTravel date: 24 May 2024", code_of(LEG_1)), ("year", "Travel date: 24 May 2025", code_of(LEG_1)), ("other", "Travel date: 3 Jun 2024", code_of(LEG_1)),
        ("none", "x", code_of(LEG_1)), ("fixed", "x", code_of(LEG_1, issued="4100")), ("unsure", "Travel date: 05/06/2024", code_of(LEG_1)),
    ]
    docs = spark.createDataFrame([(*r, REF) for r in rows], "doc_id string, text string, payload string, reference date")
    got = {r.doc_id: (r.field["value"], r.field["confidence"], [i["code"] for i in r.field["issues"]]) for r in lifecycle.fields(docs).where("field.key = 'date'").collect()}
    assert got == {
        "same": ("2024-05-24", "high", []), "year": ("2025-05-24", "high", ["auto-corrected"]), "other": ("2024-05-24", "low", ["inferred-year", "conflict"]),
        "none": ("2024-05-24", "low", ["inferred-year"]), "fixed": ("2024-05-24", "high", []), "unsure": ("2024-05-24", "low", ["inferred-year", "ambiguous-date"]),
    }


def test_railway_payloads_senders_and_categories(spark):
    slip = "PNR No.:1234567890,\nTrain No.:12951,\nTrain Name:RAJDHANI,\nPassenger Name:ASHA RAO,\nStatus:CNF,\nPassenger Name:RAVI RAO,\nFrom:NEW DELHI - NDLS,\nTo:MUMBAI - MMCT,\nDate of Journey:05-May-2024,\nQuota:GN"
    rows = [("rail", "IRCTC\nTrain No: 1 wrong\ncoach B2 berth", slip, None, None), ("event", "Cinema screen 3\nshowtime 19:30 5 May 2024\nVenue: City Hall", None, "Acme Films via Mailer", "x.com")]
    docs = spark.createDataFrame([(*r, REF) for r in rows], "doc_id string, text string, payload string, sender_name string, sender_domain string, reference date")
    got = {r.id: r for r in lifecycle.records(docs).collect()}
    f = got["rail"].fields
    assert (f["service"], f["passenger"], f["origin"], f["destination"], f["date"], f["pnr"], f["status"]) == ("12951 / RAJDHANI", "ASHA RAO, RAVI RAO", "NDLS", "MMCT", "2024-05-05", "1234567890", "CNF")
    assert got["rail"].source["passenger"] == "barcode" and got["event"].fields["category"] == "movie" and got["event"].fields["provider"] == "Acme Films"


def test_terminals_of_airports():
    lines = [{"text": "Mumbai Airport (Terminal 2)"}, {"text": "DEL Delhi,T3"}]
    assert builders.terminal_of(lines, "DEL") == "3" and builders.terminal_of(lines, None) == "2" and builders.terminal_of([], "DEL") is None


def test_places(spark):
    rows = spark.createDataFrame([("DEL", "AI", "2024-07-01"), ("lhr ", "ZZ", "2024-07-01"), ("XXX", None, None), (None, "BA", "2024-01-01")], "code string, carrier string, day string")
    got = {r.code: (r.from_city, r.airline, r.minutes) for r in places.with_airline(places.with_airport(rows, "code", "from_"), "carrier").withColumn("minutes", places.zone_offset(F.col("day"), F.lit("09:00"), F.col("from_zone"))).collect()}
    assert got == {"DEL": ("Delhi", "Air India", 330), "lhr ": ("London", "ZZ", 60), "XXX": (None, None, None), None: (None, "British Airways", None)}
    assert [r.code for r in places.known_airports(rows, "code").collect()] == ["DEL", "lhr "]
    names = spark.createDataFrame([("Bengaluru",), ("Asha Rao",), (" new york",)], "n string")
    assert sorted(r.n for r in places.airport_cities(names, "n").collect()) == [" new york", "Bengaluru"]
    assert places.airports(spark).count() == places.airports(spark).select("code").distinct().count() > 80


def test_redaction(spark):
    texts = ["Dear Ravi, PNR: AB12CD", "Ravi 9876543210 and 9876543211", "mail r@x.com, 9876543210"]
    assert redact.redact_page(texts) == ["Dear NAME1, PNR: XXXXXX", "NAME1 0000000001 and 0000000002", "mail someone@example.com, 0000000001"]
    df = spark.createDataFrame([("a@b.co +91 98765 43210", 1), (None, 2)], "t string, k int").orderBy("k")
    assert [r[0] for r in df.select(redact.redact(df.t)).collect()] == ["someone@example.com +00 0000000000", None]


def test_rasters():
    image = np.full((40, 60, 4), 255, np.uint8)
    image[5:15, 5:25, :3] = (200, 30, 30)
    image[30:35, 40:50, :3] = 0
    assert raster.background(image) == (255, 255, 255)
    mask = raster.ink_mask(image, (255, 255, 255))
    assert raster.components(mask) == [(5, 5, 20, 10, 200), (40, 30, 10, 5, 50)]
    assert raster.tight_box(mask) == (5, 5, 45, 30) and raster.dominant_colour(image) == 0xC81E1E
    assert raster.dilate(mask, 1).sum() == 22 * 12 + 12 * 7 and raster.logo_region(image) == (4, 4, 22, 12)
    assert raster.dominant_colour(np.full((3, 3, 4), 255, np.uint8)) is None and not raster.looks_like_barcode(image)
    u = np.zeros((3, 3), bool)
    u[:, [0, 2]] = u[2] = True
    assert raster.components(u) == [(0, 0, 3, 3, 7)]


def lines_of(text):
    return [{"text": t, "height": 12.0, "cells": [{"text": c} for c in re.split(r" {2,}", t)]} for t in text.split("\n")]


def test_readings_of_dates_and_times():
    assert reading.readings("16 Sep 2026, 16-SEP-26 or September 17, 2026") == ["2026-09-16", "2026-09-17"]
    assert reading.readings("08/09/2026") == ["2026-08-09", "2026-09-08"] and reading.readings("31/02/2026 2026-01-02") == ["2026-01-02"]
    assert reading.readings("16 Sep 14:35") == [] and reading.readings(None) == []
    page_ = lines_of("Booked 1 Jan 2020 07:14\n08/08/2026 14:04\n16 Sep 2026 14:35 to 5:20 pm\nLounge 23:10")
    assert reading.journey_times(page_, "2026-09-16") == ["14:35", "17:20"]
    assert reading.journey_times(page_, "2026-08-08") == ["14:04"] and reading.journey_times([], None) == []
    assert reading.clocks("24:00 12:61 12:05 am 9:30") == ["00:05", "09:30"]


def test_route_headings():
    far = lambda *rows: layout.build_lines([i for y, cells, h in rows for i in page((y, cells), height=h)])
    assert reading.route_heading(lines_of("Acme\nJaipur-> Bhim Wednesday, August 10th, 2022")) == ("Jaipur", "Bhim", 1)
    assert reading.route_heading(lines_of("Pune to Nashik")) == ("Pune", "Nashik", 0) and reading.route_heading(lines_of("Write to us for any of these")) is None
    assert reading.route_heading([]) is None and reading.route_heading(lines_of("Pune -> PUNE")) is None
    assert reading.route_heading(far((10, [(40, "Bengaluru"), (300, "Proddatur"), (500, "20-07-2017")], 20.0), (60, [(40, "fare of the day")], 8.0), (90, [(40, "body text")], 8.0))) == ("Bengaluru", "Proddatur", 0)
    assert reading.route_heading(far((10, [(40, "Ticket ID"), (300, "Order ID")], 20.0), (60, [(40, "a b")], 8.0), (90, [(40, "c d")], 8.0))) is None
    got = built("rail", "Acme bus\nTravel date: 10 Aug\nJaipur-> Bhim Wednesday, August 10th, 2022\nBoarding point: Stand")
    assert (got["origin"], got["destination"], got["date"]) == ("Jaipur", "Bhim", "2022-08-10")


def test_names_brands_and_guesses():
    assert reading.names_under_heading(lines_of("Passenger Name  ASHLEY/MARTELLE  FREQUENT FLYER\nSAN FRANCISCO INTL")) == ["ASHLEY/MARTELLE"]
    assert reading.names_under_heading(lines_of("Passenger information\nMr Ravi Rao Adult\nBengaluru\nOrigin BLR\nRavi Rao Deana\nAsha Rao")) == ["Ravi Rao", "Asha Rao"]
    assert reading.names_under_heading(lines_of("Names\nRavi Rao")) == []
    assert [reading.is_title(x) for x in ("Boarding Pass", "Dear Asha", "74] PNR: X", "Zi", "Acme Air", None, "")] == [True, True, True, True, False, False, False]
    assert [reading.carrier_name(x) for x in ("6E", "AI-2814", "XY 123", "Acme", None)] == ["IndiGo", "Air India", "XY 123", "Acme", None]
    fields = {f["key"]: f for f in builders.build("flight", [], "Boarding pass\nFlight: 6E 5306\nTravel date: 5 May 2024\n5 May 2024 09:30 - 11:00\nSeat: 3A", None, REF)}
    assert (fields["departureTime"]["value"], fields["arrivalTime"]["value"], fields["provider"]["value"]) == ("09:30", "11:00", "IndiGo")
    assert fields["departureTime"]["issues"] == [("warning", "guessed-time", "")]
    unsure = {f["key"]: f for f in builders.build("rail", [], "Travel date: 05/06/2024", None, REF)}["date"]
    assert unsure["value"] is None and unsure["issues"] == [("warning", "ambiguous-date", "2024-05-06|2024-06-05")]


def test_redaction_of_references_and_addresses():
    swap = {"AB1CD2 RESORT 123456": "XXXXXX RESORT 123456", "NH12345678901": "NH00000000", "ABCDE1234F 27ABCDE1234F1Z5": "AAAAA0000A 00AAAAA0000A0Z0", "Username = a.b-c, ok": "Username = traveller, ok", "m*XXXXXx 98XXXX12": "someone@example.com 0000000000", "1-2 Road, Plot 9, X | kept": "1/1 Sample street| kept"}
    assert redact.redact_page(list(swap)) == list(swap.values())
    many = [f"Dear Zam{c}" for c in "abcdefghijkl"]
    assert redact.redact_page(many)[-1] == "Dear NAME12"


def test_a_flight_without_captions():
    got = built("flight", "AirAsia\nBooking number AB1CD2\nAK5201\nAsha Rao\nidentification 7 kg\nDPS  11:30      15:30  BLR\n12 May 2024")
    assert (got["flight"], got["origin"], got["destination"]) == ("AK 5201", "DPS", "BLR")
    got = built("flight", "Boarding pass\nall about ID 7 and you\nAI 302 to come")
    assert got["flight"] == "AI 302" and got.get("origin") is None
    assert built("flight", "Boarding pass\nFlight: 6E 345\nAK5201")["flight"] == "6E 345"
    assert "origin" not in built("flight", "Boarding pass\nDEL and DEL\nDEL BOM GOI")


def test_terminals():
    lines = [{"text": t} for t in ("Delhi, T3", "BOM Chhatrapati Shivaji (Terminal 2)", "terminal: 1D gate")]
    assert [builders.terminal_of(lines[k:], None) for k in range(3)] == ["3", "2", "1D"]
    assert builders.terminal_of(lines, "BOM") == "2" and builders.terminal_of([{"text": "terminal building, Total 3"}], None) is None


def test_seats_and_berths_of_all_passengers():
    got = built("rail", "Train no: 12951\nFrom: Pune\nTo: Surat\nSeat/Berth: 23 LB")
    assert (got["seat"], got["berthPosition"]) == ("23", "Lower")
    got = built("rail", "Train no: 12951\nFrom: Pune\nTo: Surat\nName            Age     Status\nAsha Rao        34      CNF/B2/23/LB\nRavi Rao        36      CNF/B2/24/SIDE UPPER")
    assert (got["coach"], got["seat"], got["berthPosition"]) == ("B2", "23, 24", "Lower, Side upper")
    assert built("rail", "Train no: 12951\nSeat   Details")["seat"] is None
    assert seats.berth("S7, 42, LB") == {"coach": "S7", "number": "42", "position": "Lower"} and seats.berth("A1 12 SIDE LOWER") == {"coach": "A1", "number": "12", "position": "Side lower"}
    assert seats.berth("Adult") is None and seats.berth("") is None and seats.berth("CNF") is None


def test_a_title_needs_to_stand_out():
    got = built("event", "PVR Cinemas\nDune\nScreen 3\nSeats: A1")
    assert got["title"] is None and got["provider"] == "PVR Cinemas"
    page = lambda heights: [{"text": t, "x": 40.0, "y": 40.0 + 60 * k, "width": 90.0, "height": h} for k, (t, h) in enumerate(heights)]
    got = {f["key"]: f["value"] for f in builders.build("event", page([("PVR Cinemas", 30.0), ("Dune", 20.0), ("Total amount", 25.0), ("Screen 3", 10.0), ("Seats: A1", 10.0), ("Order 123456", 28.0), ("at the door", 10.0), ("with care", 10.0), ("thank you", 10.0)]), None, None, REF)}
    assert got["title"] == "Dune" and got["provider"] == "PVR Cinemas"


def test_names_of_stays():
    got = built("lodging", "Booking Voucher\nHotel Sunshine Palace\nCheck-in: 1 May 2024\nCheck-out: 3 May 2024")
    assert got["property"] == "Hotel Sunshine Palace" and got["provider"] is None
    assert built("lodging", "Acme Stays\nProperty name: Blue Inn\nCheck-in: 1 May 2024")["property"] == "Blue Inn"


def test_words_that_tell_lines_apart():
    assert reading.of_transaction("Booked on 8 Mar 2024") and reading.of_transaction("Invoice-date") and not reading.of_transaction("Bookshop, 8 Mar 2024")
    assert reading.is_title("E-ticket") and reading.is_title("Travel Document") and reading.is_title("Hello there") and not reading.is_title("Travel House") and not reading.is_title("Akasa Air")
    assert reading.is_person("Asha Rao") and not reading.is_person("Add-ons") and not reading.is_person("SAN FRANCISCO INTL")


def test_items_come_over_column_by_column():
    item = pa.struct([("text", pa.string()), ("x", pa.float64()), ("n", pa.int32())])
    rows = [None, [], [{"text": "a", "x": 1.5, "n": 1}, None, {"text": None, "x": None, "n": 2}], [{"text": "", "x": float("inf"), "n": None}], None, [{"text": "z", "x": -0.0, "n": 7}]]
    array = pa.array(rows, pa.list_(item))
    for part in (array, array[2:], array[1:4], array[:0], pa.array([[r] for r in rows], pa.list_(pa.list_(item))), pa.array([{}, None], pa.struct([])), pa.array([3, None, 4]), pa.array([True]), pa.array([b"x"]), pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int64()))):
        assert udf.values(part) == part.to_pylist()
    assert udf.values(array[5:])[0][0]["n"].__class__ is int


def test_cells_are_not_finished_as_lines(monkeypatch):
    made = []
    monkeypatch.setattr(layout, "finish_line", lambda items, real=layout.finish_line: made.append(items) or real(items))
    lines = layout.build_lines(page((100, [(40, "Gate"), (200, "Seat  no\t")]), (130, [(40, "4"), (200, "12A")])))
    assert [[(c["text"], c["x"]) for c in layout.split_columns(x)] for x in lines] == [[("Gate", 40), ("Seat no", 200)], [("4", 40), ("12A", 200)]]
    assert len(made) == len(lines) == 2


def test_long_steps_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert udf.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(udf, "ROWS_A_TASK", 90)
    dealt = udf.spread(table)
    assert dealt.rdd.getNumPartitions() == 12 and sorted(r[0] for r in dealt.collect()) == list(range(1000))
    assert max(dealt.rdd.glom().map(len).collect()) < 120
    assert udf.spread(dealt).rdd.getNumPartitions() == 12


def test_a_raster_is_masked_once(monkeypatch):
    made = []
    monkeypatch.setattr(raster, "ink_mask", lambda *a, real=raster.ink_mask: made.append(a) or real(*a))
    image = np.full((40, 60, 4), 255, np.uint8)
    image[5:15, 5:25, :3] = (200, 30, 30)
    got = raster.summary(image.tobytes(), 60, 40)
    assert len(made) == 1 and got["n_components"] == 1 and got["ink"] == 200 / 2400 and got["background"] == 0xFFFFFF and got["dominant"] == 0xC81E1E and not got["barcode"]


def test_components_of_rows_apart_and_of_no_ink():
    rng = np.random.default_rng(3)
    for _ in range(50):
        mask = rng.random(tuple(rng.integers(1, 12, 2))) < 0.45
        seen, want = np.zeros(mask.shape, bool), []
        for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True):
            if not seen[y, x]:
                own, todo = [], [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        own.append((a, b))
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
                ys, xs = zip(*own, strict=True)
                want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
        assert raster.components(mask) == sorted(want)
