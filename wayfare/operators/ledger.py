"""A record store that stores: versions of a table of records in Parquet, committed by a log.

A ledger is a folder. ``log/`` has one small JSON file a version, which names the data folders that the version is made
of, one for each bucket of ids. A writer reads a version, writes new folders under ``data/`` for the buckets that
its changes touch, and then commits by renaming a finished log file to the next number. That fails if the number is taken;
then the changes are applied again to what is there now. So readers see whole versions only, a writer that dies leaves the
last version as it was (and folders that nobody names, see ``vacuum``), and old versions stay readable until they are
vacuumed. Undo is a return to a version, or of some records of it.

A change is a row of the records' columns with an ``op`` (put or delete) and an order. Of changes with one id the one
of the greatest order wins, ties by its JSON text; a null op is put; changes with a null id are an error. Only the buckets that
changes touch are read and written: rows of others are not. A batch of changes may have a name; a name that the log knows
is not applied again, so a stream can hand in a batch twice.

The driver holds the log file, one entry a bucket; records never pass through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import RECORD


class Conflict(Exception):
    """Another writer has taken the version's number."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str = RECORD, buckets: int = 64, rows_a_file: int = 5_000_000):
        """The ledger at a path; it begins, empty, with its first commit. Schema and buckets are those of its log, if it has one."""
        self.spark, self.path, self.rows_a_file = spark, path.rstrip("/"), rows_a_file
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        now = self.version()
        head = self._entry(now) if now else {"schema": schema, "buckets": buckets}
        self.schema, self.buckets = head["schema"], head["buckets"]

    # -- the log

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def _at(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def versions(self) -> list[int]:
        """Numbers of all versions, in order."""
        fs, where = self._fs(f"{self.path}/log")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName()[:20]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        """The last version; 0 before the first."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "schema": self.schema, "buckets": self.buckets, "folders": {}, "batches": {}}
        fs, where = self._fs(self._at(version))
        stream = fs.open(where)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> int:
        """Write the log file under a name of its own, then rename it to its number; only one writer can."""
        fs, draft = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._jvm.org.apache.hadoop.fs.Path(self._at(entry["version"])), plain)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(self._jvm.org.apache.hadoop.fs.Path(self._at(entry["version"]))):
                raise Conflict(str(entry["version"])) from e
            raise
        return entry["version"]

    def history(self) -> DataFrame:
        """(version, action, at, batch, written, buckets) of all versions."""
        rows = [(v, e["action"], e["at"], e.get("batch"), e["written"], len(e["folders"])) for v in self.versions() for e in [self._entry(v)]]
        return self.spark.createDataFrame(rows, "version int, action string, at long, batch string, written int, buckets int")

    # -- reading

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version; of the last, if none is stated."""
        return self._rows(sorted(self._entry(self.version() if version is None else version)["folders"].values()))

    def get(self, *ids: str) -> DataFrame:
        """The records of some ids; only their buckets are read."""
        numbers = self.spark.createDataFrame([(i,) for i in ids], "id string").select(self._bucket()).distinct().collect()
        folders = self._entry(self.version())["folders"]
        return self._rows(sorted(folders[str(r[0])] for r in numbers if str(r[0]) in folders)).where(F.col("id").isin(*ids))

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def difference(self, before: int, after: int) -> DataFrame:
        """(id, change, before, after): records added, removed or changed; buckets with one folder in both are not read."""
        a, b = (self._entry(v)["folders"] for v in (before, after))
        changed = [k for k in {*a, *b} if a.get(k) != b.get(k)]
        old, new = (self._rows(sorted(x[k] for k in changed if k in x)) for x in (a, b))
        whole = lambda df, name: df.select("id", F.struct(*df.columns).alias(name))
        both = whole(old, "before").join(whole(new, "after"), "id", "full")
        same = F.to_json("before") == F.to_json("after")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~same, "changed")
        return both.select("id", change.alias("change"), "before", "after").where("change IS NOT NULL")

    # -- writing

    def _next(self, head: dict, action: str, at: int, folders: dict, written: int, batch: str | None) -> dict:
        batches = head["batches"] | ({batch: head["version"] + 1} if batch else {})
        return {"version": head["version"] + 1, "action": action, "at": at, "batch": batch, "written": written, "schema": self.schema, "buckets": self.buckets, "folders": folders, "batches": batches}

    def _write(self, rows: DataFrame, touched: list[int]) -> dict[str, str]:
        """Write the rows of the touched buckets, each as a folder; the folders of buckets that have rows."""
        name = uuid.uuid4().hex
        given = {f.name: f.dataType.simpleString() for f in rows.schema}
        columns = [F.col(f.name) if given[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)]
        # a bucket's rows go to one task, or to several if they are many
        dealt = rows.select(*columns, self._bucket().alias("bucket")).hint("rebalance", "bucket")
        dealt.write.option("maxRecordsPerFile", self.rows_a_file).partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        fs, where = self._fs(f"{self.path}/data/{name}")
        found = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(where) if f.isDirectory()}
        return {str(b): f"{name}/bucket={b}" for b in touched if str(b) in found}

    def _apply(self, build: Callable[[dict], dict | None], tries: int) -> int:
        """Commit what ``build`` makes of the last version; again, if another writer was first."""
        for left in reversed(range(tries)):
            head = self._entry(self.version())
            entry = build(head)
            if entry is None:
                return head["version"]
            try:
                return self._commit(entry)
            except Conflict:
                if not left:
                    raise
        raise Conflict("no tries")

    def merge(self, changes: DataFrame, now: int, op: str = "op", order: str = "order", batch: str | None = None, action: str = "merge", tries: int = 5) -> int:
        """Apply changes; the new version, or the last if there is nothing to do or the batch is known. Puts are stamped with ``now``."""
        columns = [f.name for f in StructType.fromDDL(self.schema)]
        row = F.struct(*(F.col(c) for c in columns)).alias("row")
        own = changes.select(F.when(F.col("id").isNull(), F.raise_error(F.lit("a change without an id"))).otherwise(F.col("id")).alias("id"), F.coalesce(F.col(op), F.lit("put")).alias("op"), F.col(order).alias("order"), row)
        last = own.groupBy("id").agg(F.max_by(F.struct("op", "row"), F.struct("order", F.to_json("row"), "op")).alias("c")).select("id", "c.op", "c.row")

        def build(head: dict) -> dict | None:
            if batch is not None and batch in head["batches"]:
                return None
            touched = sorted(r[0] for r in own.select(self._bucket().alias("b")).distinct().collect())
            if not touched:
                return None
            old = sorted(head["folders"][str(b)] for b in touched if str(b) in head["folders"])
            put = last.where("op = 'put'").select("row.*")
            if "updated_at" in columns:
                put = put.withColumn("updated_at", F.lit(now).cast("long"))
            if old:
                put = self._rows(old).join(last.select("id"), "id", "left_anti").select(*columns).unionByName(put)
            written = self._write(put, touched)
            folders = {k: v for k, v in head["folders"].items() if int(k) not in set(touched)} | written
            return self._next(head, action, now, folders, len(touched), batch)

        return self._apply(build, tries)

    def put(self, records: DataFrame, now: int, batch: str | None = None) -> int:
        """Records replace those of their id; which of several with one id wins is told by their JSON text."""
        return self.merge(records.withColumn("op", F.lit("put")).withColumn("order", F.lit(0)), now, batch=batch, action="put")

    def delete(self, ids: DataFrame, now: int, batch: str | None = None) -> int:
        """Records of these ids go; ids that are not there are no error."""
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema) if f.name != "id"]
        return self.merge(ids.select("id", *empty, F.lit("delete").alias("op"), F.lit(0).alias("order")), now, batch=batch, action="delete")

    def undo(self, now: int, to: int | None = None) -> int:
        """Return to a version; to the one before the last, if none is stated. No data is written."""

        def build(head: dict) -> dict:
            old = self._entry(max(0, head["version"] - 1) if to is None else to)
            return self._next(head, "undo", now, old["folders"], 0, None)

        return self._apply(build, 5)

    def restore(self, version: int, now: int, ids: DataFrame | None = None) -> int:
        """Records of an older version that are gone come back as they were then; those that are there stay as they are."""

        def build(head: dict) -> dict | None:
            old = self._entry(version)["folders"]
            differ = sorted(int(k) for k in old if old[k] != head["folders"].get(k))
            have = self._rows(sorted(head["folders"][str(k)] for k in differ if str(k) in head["folders"]))
            back = self._rows(sorted(old[str(k)] for k in differ)).join(have.select("id"), "id", "left_anti")
            if ids is not None:
                back = back.join(ids.select("id").distinct(), "id", "left_semi")
            touched = sorted(r[0] for r in back.select(self._bucket().alias("b")).distinct().collect())
            if not touched:
                return None
            kept = self._rows(sorted(head["folders"][str(b)] for b in touched if str(b) in head["folders"]))
            written = self._write(kept.unionByName(back.select(*kept.columns)), touched)
            return self._next(head, "restore", now, head["folders"] | written, len(touched), None)

        return self._apply(build, 5)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete all but the last ``keep`` versions, and data that no kept version names; the deleted data folders.

        Not while others write: a folder that is not committed yet is one that nobody names.
        """
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        named = {f.split("/")[0] for v in kept for f in self._entry(v)["folders"].values()}
        for v in gone:
            fs, where = self._fs(self._at(v))
            fs.delete(where, False)
        fs, where = self._fs(f"{self.path}/data")
        unused = [f.getPath() for f in (fs.listStatus(where) if fs.exists(where) else []) if f.getPath().getName() not in named]
        for p in unused:
            fs.delete(p, True)
        return sorted(p.getName() for p in unused)
