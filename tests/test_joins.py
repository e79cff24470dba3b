"""Interval joins, known codes, compared sources, name lists, images, ranks and whole-page redaction on stated rows."""

import random

import pytest

from pyspark.sql import functions as F

from wayfare.operators import bands, codes, layout, page_redaction, page_rows, quality, ranks, reading, travellers
from wayfare.sources import images


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.randint(0, 2), k, a := rng.randint(-50, 300), a + rng.choice([0, 1, 5, 40, 200, -3])) for k in range(n)]
    a, b = spans(60), spans(50)
    one, two = (spark.createDataFrame(x, "page int, id int, low int, high int") for x in (a, b))
    for width in (7.0, 60.0, 1000.0):
        got = sorted((r["page"], r["left"]["id"], r["right"]["id"], r["overlap"]) for r in bands.band_join(one, two, ["page"], "low", "high", width).collect())
        want = sorted((p, i, j, min(d, h) - max(c, g)) for p, i, c, d in a for q, j, g, h in b if p == q and d > c and h > g and min(d, h) > max(c, g))
        assert got == want
    plan = bands.band_join(one, two, ["page"], "low", "high", 60.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_cell_under_a_header(spark):
    cells = spark.createDataFrame([(1, 1, 40.0, 30.0, "a"), (1, 1, 60.0, 30.0, "b"), (1, 1, 300.0, 10.0, "far"), (1, 2, 85.0, 40.0, "edge"), (1, 2, None, 40.0, "lost")], "page_id int, row_id int, x double, width double, text string")
    headers = spark.createDataFrame([(1, 40.0, 50.0, "Name"), (2, 40.0, 50.0, "Other")], "page_id int, x double, width double, header string")
    # two cells share as much: the one further left
    assert [tuple(r) for r in bands.cells_by_header(cells, headers).collect()] == [(1, 1, "Name", "a")]


def test_routes_by_known_codes(spark):
    lines = [("d", 0, "Your booking FOR the AIR"), ("d", 1, "DPS  11:30      15:30  BLR"), ("d", 2, "DEL BOM"), ("e", 0, "DEL to del"), ("e", 1, "del, bom and GOI"), ("f", 0, "XDEL BOM1"), ("f", 3, "BOM DEL BOM")]
    got = codes.routes(spark.createDataFrame(lines, "doc_id string, line int, text string"))
    assert sorted(map(tuple, got.collect())) == [("d", "DPS", "BLR", 1), ("f", "BOM", "DEL", 3)]
    people = spark.createDataFrame([("Bengaluru",), (" new york ",), ("Asha Rao",), ("Paris Singh",)], "name string")
    assert sorted(r["name"] for r in codes.persons(people, "name").collect()) == ["Asha Rao", "Paris Singh"]


def test_sources_compared(spark):
    a = spark.createDataFrame([(1, "pnr", " ab12 "), (1, "seat", "12A"), (1, "gate", " "), (1, "from", "DEL"), (2, "pnr", None)], "doc_id int, key string, value string")
    b = spark.createDataFrame([(1, "pnr", "AB12"), (1, "seat", "14A"), (1, "terminal", "T3"), (2, "pnr", "X")], "doc_id int, key string, value string")
    got = {(r["doc_id"], r["key"]): (r["outcome"], r["confidence"], r["value"], r["other"]) for r in quality.compare_sources(a, b).collect()}
    assert got == {
        (1, "pnr"): ("corroborated", "high", " ab12 ", None), (1, "seat"): ("conflict", "low", "12A", "14A"), (1, "from"): ("decoded-only", "high", "DEL", None),
        (1, "terminal"): ("printed-only", "medium", "T3", None), (2, "pnr"): ("printed-only", "medium", "X", None),
    }


def test_longer_forms_of_a_name(spark):
    rows = [(1, 1, "Asha Rao Kumar"), (1, 2, "ASHA  RAO"), (1, 3, "Asha Raoul"), (1, 4, "asha rao"), (1, 5, " "), (1, 6, None), (2, 1, "Ravi"), (2, 2, "Ravi Rao Iyer"), (None, 1, "Ravi Rao")]
    got = travellers.distinct_names(spark.createDataFrame(rows, "doc_id int, position int, name string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "ASHA RAO", 1), (1, "Asha Raoul", 3), (2, "Ravi", 1), (None, "Ravi Rao", 1)], key=repr)


def test_image_tags_and_states(spark):
    html = """<IMG src="cid:a%20b" alt='x > y' WIDTH=200 height="210px"><img data-src="no" src=http://t/logo.png width=300 height=90 alt=ticket/><img alt="none"><img src="data:x" width="5%"><img src='CID:<c&amp;d>'>"""
    pages = spark.createDataFrame([("m", html), ("n", None)], "doc_id string, html string")
    parts = spark.createDataFrame([("m", "<a b>", "image/png", 5), ("m", "c&d", "image/gif", 7), ("n", "a b", "image/png", 5), ("m", None, "x", 1)], "doc_id string, key string, content_type string, size long")
    tags = images.image_tags(pages)
    assert [tuple(r) for r in tags.orderBy("ord").collect()] == [
        ("m", 0, "cid:a%20b", "x > y", 200, 210), ("m", 1, "http://t/logo.png", "ticket/", 300, 90), ("m", 2, "", "none", None, None), ("m", 3, "data:x", "", None, None), ("m", 4, "CID:<c&d>", "", None, None),
    ]
    assert [(r["state"], r["content_type"]) for r in images.resolve(tags, parts).orderBy("ord").collect()] == [("embedded", "image/png"), ("remote", None), ("none", None), ("inline", None), ("embedded", "image/gif")]
    # 50 for the square, 4 for its area; 35 for the stripe, 2 for its area, 30 for the ticket, 40 off for the logo
    assert [(r["ord"], r["score"], r["rank"]) for r in images.candidates(tags).orderBy("rank").collect()] == [(0, 54, 1), (1, 27, 2)]


def test_candidates_are_cut_before_the_shuffle(spark):
    many = spark.range(5000).select((F.col("id") % 1).alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit("").alias("src"), F.lit("").alias("alt"), F.lit(200).alias("width"), F.lit(200).alias("height"))
    best = images.candidates(many)
    assert [r["ord"] for r in best.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_ranks_of_one_large_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.lit("b")).alias("g"), (3000 - F.col("id")).alias("k"))
    got = ranks.rank_within(df, ["g"], ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["k"], r["rank"]))
    assert {g: len(x) for g, x in by.items()} == {"hot": 2700, "b": 150, None: 150}
    assert all([r for _, r in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())


def test_a_page_is_redacted_alike(spark):
    items = [
        ("p", 0, 40.0, 10.0, "Dear ASHA,"), ("p", 1, 40.0, 30.0, "Ms. Meera Nair (Primary Guest)"), ("p", 2, 40.0, 50.0, "MR"), ("p", 3, 80.0, 50.0, "RAVI ADULT"), ("p", 4, 40.0, 70.0, "call 9876543210 or 9123456780, Meera"),
        ("p", 5, 40.0, 90.0, "asha 9123456780 ravi"), ("p", 6, 40.0, 110.0, "asha.rao@mail."), ("p", 7, 200.0, 110.0, "example.org"), ("p", 8, 40.0, 130.0, "whole@mail.org"), ("p", 9, 40.0, 150.0, None),
        ("q", 0, 40.0, 10.0, "9123456780"), ("q", 1, 40.0, 10.0, "Asha is no name here"), (None, 0, 0.0, 0.0, "Dear Ravi 9123456780"),
    ]
    df = spark.createDataFrame(items, "page string, item int, x double, y double, text string")
    got = {(r["page"], r["item"]): r["text"] for r in page_redaction.redact_pages(df).collect()}
    assert len(got) == len(items)
    assert got["p", 0] == "Dear SAMPLE," and got["p", 1] == "Ms. TRAVELLER PERSON (Primary Guest)" and got["p", 3] == "GUEST ADULT"
    assert got["p", 4] == "call 1234567890 or 1234679001, TRAVELLER" and got["p", 5] == "SAMPLE 1234679001 GUEST"
    assert got["p", 6] + got["p", 7] == "traveller@example.com" and len(got["p", 6]) == 12 and got["p", 8] == "whole@mail.org" and got["p", 9] is None
    assert got["q", 0] == "1234567890" and got["q", 1] == "Asha is no name here" and got[None, 0] == "Dear SAMPLE 1234567890"


def test_islands_of_one_large_group(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for group, n in (("hot", 2500), ("b", 40), (None, 30)):
        at, island = 0, 0
        for k in range(n):
            step = rng.choice([0, 1, 2, 9])
            island += k > 0 and step > 3
            at += step
            rows.append((group, k, at, 3))
            want[group, k] = island
    got = ranks.islands(spark.createDataFrame(rows, "g string, k int, at int, gap int").repartition(7), ["g"], ["at", "k"], "at", "gap").collect()
    assert {(r["g"], r["k"]): r["island"] for r in got} == want


def test_lines_and_cells_of_rows_are_those_of_arrays(spark):
    rng = random.Random(9)
    pages = {}
    for p in range(12):
        items = []
        for line in range(rng.randint(1, 9)):
            x = 40.0
            for _ in range(rng.randint(1, 6)):
                text = "".join(rng.choice("abcXY") for _ in range(rng.randint(1, 8)))
                items.append({"text": text, "x": x, "y": 30.0 * line + rng.choice([0.0, 1.0, 2.0]), "width": 5.0 * len(text), "height": 10.0})
                x += 5.0 * len(text) + rng.choice([2.0, 6.0, 30.0])
        pages[p] = items
    rows = [(p, k, *(i[c] for c in ("text", "x", "y", "width", "height"))) for p, items in pages.items() for k, i in enumerate(items)] + [(0, 99, " ", 1.0, 1.0, 1.0, 1.0), (0, 98, "lost", None, 1.0, 1.0, 1.0)]
    df = page_rows.with_cells(page_rows.with_lines(spark.createDataFrame(rows, "page int, item int, text string, x double, y double, width double, height double")))
    texts = {}
    for r in page_rows.cell_texts(df).orderBy("page", "line", "cell").collect():
        texts.setdefault((r["page"], r["line"]), []).append(r["text"].replace(" ", ""))
    boxes = {(r["page"], r["line"]): (r["n"], r["cells"], r["x"], r["y"], round(r["width"], 6), r["height"]) for r in page_rows.line_boxes(df).collect()}
    for p, items in pages.items():
        for k, line in enumerate(layout.build_lines(items)):
            cells = layout.split_columns(line)
            assert texts[p, k] == [c["text"].replace(" ", "") for c in cells]
            assert boxes[p, k] == (len(line["items"]), len(cells), line["x"], line["y"], round(line["width"], 6), line["height"])
    assert len(boxes) == sum(len(layout.build_lines(i)) for i in pages.values())


@pytest.mark.parametrize("large", [10, 1_000_000])
def test_groups_of_a_task_are_shuffled_once(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE", large)
    df = spark.range(60).select(F.when(F.col("id") >= 8, F.lit("hot")).when(F.col("id") >= 4, F.lit("b")).alias("g"), F.col("id").alias("k"), (F.col("id") * F.when(F.col("id") % 5 == 0, 2).otherwise(1)).alias("at"), F.lit(3).alias("gap"))
    got = ranks.islands(df, ["g"], ["at", "k"], "at", "gap")
    by, want = {}, {}
    for r in df.orderBy("at", "k").collect():
        own = by.setdefault(r["g"], [])
        want[r["g"], r["k"]] = 0 if not own else own[-1][1] + (r["at"] - own[-1][0] > 3)
        own.append((r["at"], want[r["g"], r["k"]]))
    assert {(r["g"], r["k"]): r["island"] for r in got.collect()} == want and len(set(want.values())) > 3
    pages = df.select(F.col("g").alias("page"), F.col("k").alias("item"), F.lit("a").alias("text"), (F.col("k") % 3 * 25.0).alias("x"), F.col("at").cast("double").alias("y"), F.lit(20.0).alias("width"), F.lit(6.0).alias("height"))
    boxes = page_rows.line_boxes(page_rows.with_cells(page_rows.with_lines(pages)))
    assert large < 60 or boxes._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r["page"], r["line"]) for r in boxes.collect()} == set(zip((g for g, _ in want), want.values(), strict=True)) and sum(r["n"] for r in boxes.collect()) == 60


@pytest.mark.parametrize("large", [9, 1_000_000])
def test_cells_and_headers_of_a_page_are_shuffled_once(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE", large)
    rng = random.Random(5)
    cells = [(p, r, float(rng.randint(-80, 300)), float(rng.choice([0, 5, 40, 150])), f"{p}{r}{k}") for p, n in (("a", 2), ("b", 9), (None, 2)) for r in range(n) for k in range(4)] + [("a", 0, None, 4.0, "lost")]
    headers = [(p, x, w, h) for p in ("a", "b", None) for h, x, w in (("H", -20.0, 60.0), ("I", 70.0, 60.0), ("J", 100.0, 200.0), (None, 90.0, 30.0), ("K", 10.0, 0.0))]
    one, two = spark.createDataFrame(cells, "page_id string, row_id int, x double, width double, text string"), spark.createDataFrame(headers, "page_id string, x double, width double, header string")
    best = {}
    for p, r, x, w, t in cells:
        for q, hx, hw, h in headers:
            if p is not None and p == q and x is not None and w > 0 and hw > 0:
                shared = min(x + w, hx + hw) - max(x, hx)
                if shared > 0.35 * min(w, hw):
                    best[p, r, h] = max(best.get((p, r, h), (0, 0, "")), (shared, -x, t))
    found = bands.cells_by_header(one, two)
    assert large < 60 or found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r["page_id"], r["row_id"], r["header"]): r["text"] for r in found.collect()} == {k: v[2] for k, v in best.items()} and len(best) > 15 and found.count() == len(best)


def test_columns_read_as_the_plain_functions(spark):
    texts = ["Boarding pass", "e-Ticket", "Dear guest", "IndiGo", "AI 302", "AI", "zz 12", "Travel House", "Acme Air Lines of Old Times", "ab", None, "", "Hello", "A/B tours", "Document of travel", "12 May 2024, 13 June 24 and 1/2/2024", "May 3rd, 2023 2024-02-30 2024-02-29 31.04.2024", "5 May 24: 10"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in df.select("k", reading.looks_like_title(F.col("t")).alias("title"), reading.expand_carrier(F.col("t")).alias("carrier"), reading.dates_on_line(F.col("t")).alias("dates"), layout.grid_items(F.col("t")).alias("grid")).collect()}
    for k, t in enumerate(texts):
        assert got[k]["title"] == reading.is_title(t) and got[k]["carrier"] == reading.carrier_name(t) and got[k]["dates"] == reading.readings(t), t
    assert [tuple(i) for i in got[2]["grid"]] == [("Dear", 0.0, 0.0, 28.0, 12.0), ("guest", 35.0, 0.0, 35.0, 12.0)] and got[10]["grid"] is None and got[11]["grid"] == []
    long = "  ab  c\n\nx" + " yy" * 4000
    grid = spark.createDataFrame([(long,)], "t string").select(layout.grid_items(F.col("t"))).first()[0]
    assert [tuple(i)[:3] for i in grid[:3]] == [("ab", 14.0, 0.0), ("c", 42.0, 0.0), ("x", 0.0, 32.0)] and [i["x"] for i in grid[3:]] == [7.0 * (2 + 3 * k) for k in range(4000)]
