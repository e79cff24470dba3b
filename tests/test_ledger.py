"""The ledger: versions, order of changes, undo, conflicts, dying writers; and the stream that fills it."""

import pytest
from pyspark.sql import functions as F

from wayfare.operators import ledger as module
from wayfare.operators.ledger import Conflict, Ledger
from wayfare.streaming import intake

SCHEMA = "id string, fields map<string,string>, departs_at long, updated_at long, source string"


def records(spark, *rows):
    return spark.createDataFrame([(i, {"pnr": i.upper()}, 5, None, s) for i, s in rows], SCHEMA)


def content(df):
    return {r["id"]: (r["source"], r["updated_at"]) for r in df.collect()}


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/book", SCHEMA, buckets=4)


def test_versions_and_undo(spark, book):
    assert book.version() == 0 and book.read().collect() == []
    first = book.put(records(spark, *((f"r{i}", "one") for i in range(20))), now=10)
    second = book.delete(records(spark, ("r3", ""), ("r4", ""), ("absent", "")), now=11)
    third = book.put(records(spark, ("r4", "new"), ("r5", "new")), now=12)
    assert (first, second, third) == (1, 2, 3)
    assert len(content(book.read(1))) == 20 and "r3" not in content(book.read(2)) and content(book.read())["r5"] == ("new", 12)
    assert content(book.get("r5", "r6", "r3")) == {"r5": ("new", 12), "r6": ("one", 10)}
    # undo of the delete alone: what came later stays
    assert book.restore(1, now=13) == 4
    assert content(book.read()) == content(book.read(1)) | {"r4": ("new", 12), "r5": ("new", 12)}
    assert book.restore(1, now=13) == 4
    # return to a version
    assert book.undo(now=14, to=2) == 5 and content(book.read()) == content(book.read(2))
    assert book.undo(now=15) == 6 and content(book.read()) == content(book.read(4))
    assert {r["id"]: r["change"] for r in book.difference(1, 3).collect()} == {"r3": "removed", "r4": "changed", "r5": "changed"}
    assert [r["action"] for r in book.history().orderBy("version").collect()] == ["put", "delete", "put", "restore", "undo", "undo"]
    again = Ledger(spark, book.path, "id string", buckets=99)
    assert (again.schema, again.buckets) == (SCHEMA, 4)


def test_the_last_change_of_an_id_wins(spark, book):
    rows = [("a", 2, "put", "late"), ("a", 1, "put", "early"), ("b", 1, "put", "x"), ("b", 2, "delete", "x"), ("c", 1, "delete", "x"), ("c", 2, None, "back"), ("d", 1, "put", "p"), ("d", 1, "put", "q")]
    changes = spark.createDataFrame(rows, "id string, order int, op string, source string").selectExpr("id", "order", "op", "source", "map() AS fields", "cast(null as long) AS departs_at", "cast(null as long) AS updated_at")
    for partitions in (1, 3):
        other = Ledger(spark, f"{book.path}{partitions}", SCHEMA, buckets=4)
        other.merge(changes.repartition(partitions), now=1)
        assert content(other.read()) == {"a": ("late", 1), "c": ("back", 1), "d": ("q", 1)}
    with pytest.raises(Exception, match="without an id"):
        book.merge(changes.withColumn("id", F.when(F.col("id") != "a", F.col("id"))), now=1)
    assert book.version() == 0


def test_only_touched_buckets_are_written(spark, book):
    book.put(records(spark, *((f"r{i}", "one") for i in range(50))), now=1)
    before = book._entry(1)["folders"]
    book.put(records(spark, ("r7", "two")), now=2)
    after = book._entry(2)["folders"]
    assert sum(before[k] != after[k] for k in before) == 1 and len(content(book.read())) == 50
    assert book.put(records(spark).limit(0), now=3) == 2


def test_writers_that_meet(spark, book, monkeypatch):
    book.put(records(spark, ("a", "one")), now=1)
    other, plain = Ledger(spark, book.path), Ledger._commit
    raced = []

    def late(self, entry):
        if not raced:
            raced.append(other.put(records(spark, ("b", "other")), now=2))
        return plain(self, entry)

    monkeypatch.setattr(book, "_commit", late.__get__(book))
    assert book.put(records(spark, ("c", "mine")), now=3) == 3
    assert {k: v[0] for k, v in content(book.read()).items()} == {"a": "one", "b": "other", "c": "mine"}
    monkeypatch.undo()
    with pytest.raises(Conflict):
        book._commit(book._entry(2))
    assert book.version() == 3


def test_a_writer_that_dies_leaves_the_version(spark, book, monkeypatch):
    book.put(records(spark, ("a", "one")), now=1)
    monkeypatch.setattr(Ledger, "_commit", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        book.put(records(spark, ("a", "two"), ("b", "two")), now=2)
    monkeypatch.undo()
    assert book.version() == 1 and content(book.read()) == {"a": ("one", 1)}
    book.put(records(spark, ("b", "three")), now=3)
    unused = book.vacuum(keep=2)
    assert len(unused) == 1 and content(book.read()) == {"a": ("one", 1), "b": ("three", 3)} and content(book.read(1)) == {"a": ("one", 1)}
    book.put(records(spark, ("b", "four")), now=4)
    book.vacuum(keep=1)
    assert book.versions() == [3] and content(book.read()) == {"a": ("one", 1), "b": ("four", 4)}


def files(spark, *rows):
    return spark.createDataFrame([(*r, None, "2024-01-02T00:00:00") for r in rows], "share string, place int, name string, text string, payload string, arrived string").withColumn("arrived", F.to_timestamp("arrived"))


AIR = "Boarding pass\nairport terminal PNR: AB12CD\nFlight AI 302"


def test_batches_are_taken_in_once(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/book", buckets=4)
    batch = files(spark, ("s1", 1, "second", "nothing"), ("s1", 0, "first", AIR), ("s2", 0, "note", "nothing here"), ("s3", 0, "blank", " "), (None, 0, "lost", AIR))
    rejects = f"file://{tmp_path}/rejects"
    assert intake.take_in(batch, 0, book, rejects, now=5) == 1
    assert intake.take_in(batch, 0, book, rejects, now=6) == 1  # again
    assert [(r["id"], r["kind"], r["added_at"]) for r in book.read().collect()] == [("s1", "flight", 5)]
    assert {(r["share"], r["refused"]) for r in spark.read.parquet(rejects).collect()} == {("s2", "unknown-kind"), ("s3", "empty")}
    assert intake.take_in(files(spark, ("s4", 0, "a", AIR)), 1, book, rejects, now=7) == 2
    assert {r["id"] for r in book.read().collect()} == {"s1", "s4"}


def test_a_stream_that_is_killed_before_the_commit(spark, tmp_path, monkeypatch):
    schema = "share string, place int, name string, text string, payload string, arrived timestamp"
    files(spark, ("s1", 0, "first", AIR), ("s2", 0, "note", "nothing here")).coalesce(1).write.json(f"{tmp_path}/in")
    book = Ledger(spark, f"file://{tmp_path}/book", buckets=4)
    stream = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in")
    start = lambda: intake.start(stream(), book, f"file://{tmp_path}/rejects", f"{tmp_path}/cp", now=5)
    plain = Ledger._commit
    monkeypatch.setattr(module.Ledger, "_commit", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert book.version() == 0 and spark.read.parquet(f"{tmp_path}/rejects").count() == 1
    # the commit was made, but the stream died before it noted so
    monkeypatch.setattr(module.Ledger, "_commit", lambda self, entry: (plain(self, entry), (_ for _ in ()).throw(OSError("killed")))[0])
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.undo()
    assert book.version() == 1
    start().awaitTermination()
    assert book.version() == 1 and {r["id"] for r in book.read().collect()} == {"s1"} and spark.read.parquet(f"{tmp_path}/rejects").count() == 1
    files(spark, ("s5", 0, "first", AIR)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    start().awaitTermination()
    assert book.version() == 2 and {r["id"] for r in book.read().collect()} == {"s1", "s5"}
