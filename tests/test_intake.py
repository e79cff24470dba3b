import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfare.functions import scalars
from wayfare.operators import layout, store
from wayfare.plans import lifecycle
from wayfare.sources import files, intake


def test_precedence_and_descriptions(spark):
    rows = spark.createDataFrame([("f", "h", "t"), (" ", "h", "t"), (None, None, "t"), (None, "", None)], "f string, h string, t string")
    assert [tuple(r[0]) for r in rows.select(intake.best_source(F.col("f"), F.col("h"), F.col("t"))).collect()] == [("file", "f"), ("html", "h"), ("text", "t"), (None, None)]
    rows = spark.createDataFrame([("email", 1), ("pdf-text", 3), ("odd", None)], "k string, n int")
    assert [r[0] for r in rows.select(intake.describe(F.col("k"), F.col("n"))).collect()] == ["e-mail", "PDF with text, 3 pages", "document"]
    rows = spark.createDataFrame([("EAN-13",), ("QRCode",), ("MaxiCode",)], "f string")
    assert [r[0] for r in rows.select(intake.symbology(F.col("f"))).collect()] == ["ean13", "qrcode", None]


def test_html_becomes_lines_and_items(spark):
    page = "<head><title>t</title></head><p>Gate &amp; seat</p><script>x()</script><table><tr><td>A</td><td>12</td></tr></table>b<br>c"
    df = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(intake.html_text_lines(F.col("h"))).collect()] == ["Gate & seat\nA  12\nb\nc", "", None]
    items = df.select(intake.html_items(F.col("h")).alias("i")).first().i
    assert [(i.text, i.x, i.y) for i in items] == [("Gate", 0, 0), ("&", 35, 0), ("seat", 49, 0), ("A", 0, 16), ("12", 21, 16), ("b", 0, 32), ("c", 0, 48)]


def test_ocr_lines_are_as_sure_as_their_least_word(spark):
    words = [("Gate", 0.0, 0.0, 20.0, 10.0, 0.9), ("14", 24.0, 1.0, 10.0, 10.0, 0.4), ("x", 0.0, 40.0, 5.0, 10.0, 0.8)]
    df = spark.createDataFrame([(words,)], "w array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double>>")
    assert [(r.text, r.confidence) for r in df.select(intake.ocr_lines(F.col("w")).alias("l")).first().l] == [("Gate 14", 0.4), ("x", 0.8)]


@pytest.mark.parametrize(
    ("content", "path", "want"),
    [(b"%PDF-1.4", "a", "pdf"), (b"\x89PNG....", "a", "png"), (b"\xff\xd8\xff\xe0", "a", "jpeg"), (b"hello there", "a", "text"), (b"\x00\x01\x02\x03" * 9, "a.eml", "text"), (b"\x00\x01\x02\x03" * 9, "a.bin", None), (b"abc", "a.txt", None), (b"RIFF\x10\x00\x00\x00WEBPxx", "a", "webp"), (b"BMTC Daily pass Rs 70", "a", "text"), (b"BM\x00\x10\x00\x00", "a", "bmp"), (b"0000ftypheic\x00\x01", "a", "heif")],
)
def test_files_are_known_by_their_bytes(spark, content, path, want):
    df = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    assert files.ingest(df).first().kind == want


def test_refusals(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray()), ("c.txt", bytearray(b"x" * (5 << 20))), ("d", bytearray(b"%PDF" + b"x" * (9 << 20))), ("e", bytearray(b"\x00\x01\x02\x03" * 4))], "path string, content binary")
    assert [r.refused for r in files.ingest(df).select("refused").collect()] == ["empty", "empty", "text-too-large", "too-large", "unknown-type"]


def test_pages(spark):
    item = lambda t, y: (t, 0.0, float(y), 10.0, 10.0)
    rows = [("d", 0, [item(" ", 10)]), ("d", 1, [item("x" * 60, 700)]), ("d", 5, [item("y" * 300, 1)])]
    df = spark.createDataFrame(rows, "doc_id string, page int, items array<struct<text:string,x:double,y:double,width:double,height:double>>")
    a = df.withColumn("items", files.normalise_items(F.col("items"), F.lit(800.0))).withColumn("a", layout.assess_text(F.col("items"), F.lit(72.0), F.lit(72.0))).withColumn("has_text", F.col("a.has_text"))
    got = files.primary_page(a).first()
    assert (got.page, got.a.characters, got.a.density, got.a.partial, got["items"][0].y) == (1, 60, 9.3, True, 90.0)


def test_palettes_are_stable_and_readable(spark):
    df = spark.createDataFrame([("Acme Rail",), ("acme rail ",), ("Blue Bus",)], "n string").select(scalars.palette(F.col("n")).alias("p")).collect()
    assert df[0].p == df[1].p != df[2].p
    assert spark.createDataFrame([(r.p.background,) for r in df], "c int").select(F.min(scalars.contrast(F.col("c"), F.lit(0xFFFFFF)))).first()[0] >= 4.5
    assert spark.range(1).select(scalars.from_hsl(F.lit(0.0), F.lit(1.0), F.lit(0.5))).first()[0] == 0xFF0000


def test_captured_layouts(spark, tmp_path):
    run = '{"text": "Seat 12A", "x": 40, "y": 110, "width": 50, "height": 10}, {"text": "  ", "x": 1, "y": 1, "width": 1, "height": 1}, {"text": null}'
    turned = '{"text": "Gate", "transform": [3, 4, 6, 8, 55, 100]}, {"text": "wide", "transform": [1, 0, 0, 12, 5, 7], "width": 33}'
    page = lambda items: '{"width": 200, "height": 300, "items": [' + items + "]}"
    texts = {"a": '{"name": "one",\n"pages": [' + ", ".join([page(run), page(turned), page(""), page(run)]) + "]}", "b": "no JSON", "c": '{"name": "empty", "pages": []}', "d": '{"pages": [' + page(run) + "]}"}
    for k, t in texts.items():
        (tmp_path / f"{k}.json").write_text(t)
    got = files.read_layouts(spark, str(tmp_path)).collect()
    by = {(r["doc_id"].rsplit("/", 1)[-1], r["page"]): r for r in got}
    assert set(by) == {("one", 0), ("one", 1), ("one", 2), ("b.json", None), ("empty", None), ("d.json", 0)}
    assert [tuple(i) for i in by["one", 0]["items"]] == [("Seat 12A", 40.0, 100.0, 50.0, 10.0)]
    assert [tuple(i) for i in by["one", 1]["items"]] == [("Gate", 55.0, 190.0, 20.0, 10.0), ("wide", 5.0, 281.0, 33.0, 12.0)]
    assert by["one", 2]["items"] == [] and by["b.json", None]["refused"] == by["empty", None]["refused"] == "unreadable" and by["d.json", 0]["refused"] is None
    lines = "\n".join(texts[k].replace("\n", " ") for k in ("a", "b"))
    (tmp_path / "all.jsonl").write_text(lines)
    assert files.read_layouts(spark, str(tmp_path / "all.jsonl"), whole_files=False, most=2).count() == 3


def test_a_ticket_keeps_what_its_draft_holds(spark):
    payload = "M2" + "DOE/JANE MRS".ljust(20) + "E" + "AB12CD DELBOMAI 0123 145Y012C0045 100" + "AB12CD BOMGOIAI 0456 146Y014A0046 100"
    docs = spark.createDataFrame([("a", "Boarding pass\nPNR: AB12CD\nGate: 14", payload, dt.date(2024, 3, 1)), ("b", "Boarding pass\nFlight: AI 302\nPassenger information\nAsha Rao\nRavi Rao", None, dt.date(2024, 3, 1))], "doc_id string, text string, payload string, reference date")
    got = {r["id"]: r for r in lifecycle.tickets(docs, now=7).collect()}
    a, b = got["a"], got["b"]
    assert a["kind"] == "flight" and a["fields"]["pnr"] == "AB12CD" and a["provenance"]["pnr"]["source"] == "barcode" and a["provenance"]["pnr"]["critical"] and a["departs_at"] == 1716508800000
    assert [tuple(x) for x in a["additional_legs"]] == [("BOM", "GOI", "AI 456", "2024-05-25", "14A")] and not any(k.startswith("leg") for k in a["fields"])
    assert b["passengers"] == ["Asha Rao", "Ravi Rao"] and b["additional_legs"] is None and "gate" not in b["fields"]
    opened = {r["doc_id"]: {f["key"]: f for f in r["fields"]} for r in store.to_draft(lifecycle.tickets(docs, now=7)).collect()}
    assert opened["a"]["leg2.flight"]["value"] == "AI 456" and opened["a"]["pnr"]["confirmed"] and opened["a"]["pnr"]["source"] == "barcode"
    again = {r["id"]: (r["fields"], r["additional_legs"], r["passengers"]) for r in store.from_draft(store.to_draft(lifecycle.tickets(docs, now=7)), now=9).collect()}
    assert again == {k: (r["fields"], r["additional_legs"], r["passengers"]) for k, r in got.items()}
