"""Every query of the engine runs; those with SQL agree with it, and streams give what batches give."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare import catalog, catalog_joins
from wayfare.operators import quality, store
from wayfare.operators.classify import select_kind
from wayfare.streaming import landing

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (float, np.floating, decimal.Decimal)):
            return f"{float(x):.6g}"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return str(x)

    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


QUERIES, ORACLES = catalog.QUERIES | catalog_joins.QUERIES, catalog.ORACLES | catalog_joins.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got)


def agrees(spark, name, where):
    """Rows of a query, held against its SQL on tables of a test's own."""
    c = duckdb.connect()
    for t in where.iterdir():
        c.execute(f"create view {t.stem} as select * from '{t}/*.parquet'")
    got = QUERIES[name](spark, str(where)).toPandas()
    want = c.execute(ORACLES[name]).df().astype(object)
    assert rows(got) == rows(want.where(want.notna(), None))
    return got


def test_mime_parse_of_long_empty_and_absent_parts(spark, tmp_path):
    pages = [(1, "http://x.example/" + "a" * 300, "<p>é</p>" * 60), (2, "http://x.example/ü€" + "b" * 40, ""), (3, "", "x"), (4, None, "y"), (5, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(agrees(spark, "mime_parse", tmp_path)) == 5


def test_document_signals_of_accents_beside_codes(spark, tmp_path):
    texts = ["vel ORRÓRR 79. et", "nè ÈRE 33", "RR 79È", "süß 12", "ß 34", "aé1 22", "ıa 12", "AI’12 x", "ÀAI 2.", "a_b 12", "é10:30 le 3 mars", "AI-'. 123", "", None]
    docs = [(k * 40 + i, t) for k in range(8) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(agrees(spark, "document_signals", tmp_path)) == len(docs)


def test_document_signals_of_words_that_are_signals(spark, tmp_path):
    texts = [
        "was, anden thshat", "write to pnr@site.example", "Cinema Screen 4, hotel; SEAT", "Mayhan 12:30", "a vs b 12:30", "itineraries WL 12", "abc-def (ghi) x (jkl)", "seat", "ea 12 class", "check-in by check-out 3 nights",
        "chart is prepared", "berth", "boarding pass", "baggage tax invoice", "ſeat quota Quai", "12 Jan 10:30", "2D IMAX", "retiring room", "train no", "screen4 ROW B 3 rated: PG", "hall 3", "x (abc) y (def)",
    ]
    docs = [(k * 40 + i, t) for k in range(24) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(agrees(spark, "document_signals", tmp_path)) == len(docs)


def test_stream_equals_batch(spark, tmp_path):
    data = [("a", "Boarding pass airport PNR gate seat", None, "2024-01-01T00:00:00Z"), ("b", "Hotel check-in check-out 2 nights voucher", None, "2024-01-01T00:00:01Z"), ("a", "Boarding pass airport PNR gate seat", None, "2024-01-01T00:00:00Z")]
    df = spark.createDataFrame(data, "id string, text string, payload string, arrived string").selectExpr("id", "text", "payload", "cast(arrived as timestamp) arrived")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    q = landing.write(landing.classified(landing.landing(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.id, r.kind) for r in select_kind(df).collect()} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_reference_lookup_keeps_all_names(spark, tmp_path):
    spark.range(3000).selectExpr("id AS c_custkey", "id AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name", "id % 6 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(5).selectExpr("id AS r_regionkey", "concat('r', id) AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    got = {tuple(r) for r in catalog.reference_lookup(spark, str(tmp_path)).collect()}
    assert got == {(k, f"n{k}", f"r{k % 6}" if k % 6 < 5 else "unknown") if k % 7 else (k, f"#{k}", "unknown") for k in range(3000)}


def test_long_rules_are_dealt_over_all_cores(spark):
    assert QUERIES["redact_planted"](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_records_are_opened_beside_themselves(spark):
    plan = QUERIES["draft_round_trip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_only_keys_of_legs_are_legs(spark):
    def field(key, value):
        return quality.new_field(F.lit(key), F.lit(value), F.lit("ocr"))

    keys = ("legend", "leg.origin", "leg2x.origin", "leg99999999999.origin", "leg10.origin", "leg3.seat", "leg03.date", "leg2.", "leg2.origin", "xleg4.origin")
    some, none = F.array(*(field(k, k) for k in keys)), F.array(field("origin", "DEL"), field("leg2.origin", " "))
    drafts = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("flight").alias("kind"), F.when(F.col("id") == 0, some).otherwise(none).alias("fields"))
    got = {r["id"]: r for r in store.from_draft(drafts, now=1).collect()}
    assert [(x["origin"], x["seat"], x["date"]) for x in got["0"]["additional_legs"]] == [("leg2.origin", None, None), (None, "leg3.seat", None), ("leg10.origin", None, None)]
    assert got["1"]["additional_legs"] is None and set(got["1"]["fields"]) == {"origin"} and {"legend", "leg.origin", "leg2x.origin", "xleg4.origin"} == set(got["0"]["fields"])
