"""Record store: upsert, what is next or past, retention, backup, and lookups on it.

A store is a DataFrame of ``schemas.RECORD``; times are epoch milliseconds, and now is always a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound, departure_timestamp
from ..schemas import FIELDS, ORIGIN
from .quality import new_field

HOUR, DAY = 3_600_000, 86_400_000
GRACE = 6 * HOUR
#: Days that a policy keeps a record after it left; None for ever.
POLICIES = {"keep": None, "month": 30, "week": 7, "at-once": 0}
FORMAT = "wayfare-backup-1"


def side(departs: Column, archived: Column, now: Column | int) -> Column:
    """upcoming or past: archived is past, no time is upcoming, six hours of grace after departure."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.when(F.coalesce(archived, F.lit(False)), "past").when(departs.isNull() | (departs + GRACE >= now), "upcoming").otherwise("past")


def partition(records: DataFrame, now: int) -> DataFrame:
    """Records with their side and sort key: upcoming by departure, none first; past by the latest first."""
    out = records.withColumn("side", side(F.col("departs_at"), F.col("archived"), now))
    when = F.coalesce(F.nullif(F.col("departs_at"), F.lit(0)), F.col("added_at"))
    return out.withColumn("sort_key", F.when(F.col("side") == "past", -when).otherwise(F.coalesce("departs_at", F.lit(-(1 << 62)))))


def next_record(records: DataFrame, now: int) -> DataFrame:
    """The head of what is upcoming; ties go to the lower id."""
    return partition(records, now).where("side = 'upcoming'").orderBy("sort_key", "id").limit(1).drop("side", "sort_key")


def expired(records: DataFrame, now: int, days: int | None) -> DataFrame:
    """Records that left more than the grace and so many days ago; archived ones too, those without a time never."""
    if days is None:
        return records.limit(0)
    return records.where(F.col("departs_at") < F.lit(now - GRACE - days * DAY))


def retain(records: DataFrame, now: int, policy: str) -> DataFrame:
    days = POLICIES[policy]
    if days is None:
        return records
    return records.where(F.coalesce(F.col("departs_at") >= F.lit(now - GRACE - days * DAY), F.lit(True)))


def upsert(records: DataFrame, changes: DataFrame, now: int, order: str | None = None) -> DataFrame:
    """Changes replace records of their id and are stamped; of changes with one id the one of the greatest ``order`` stays, ties by its JSON text.

    Both are frames, and nothing is written: a ``Ledger`` keeps what it merges.
    """
    columns = [c for c in changes.columns if c != order or c in records.columns]
    row = F.struct(*columns)
    rank = F.struct(F.col(order), F.to_json(row)) if order else F.to_json(row)
    fresh = changes.groupBy("id").agg(F.max_by(row, rank).alias("r")).select("r.*").withColumn("updated_at", F.lit(now).cast("long"))
    return records.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def removed(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole records that ``delete`` takes away: keep them for ``restore``."""
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def restore(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Undo of a delete: records come back as they were; an id that is there again stays as it now is."""
    return records.unionByName(kept.join(records.select("id"), "id", "left_anti"))


def past_count(records: DataFrame, now: int) -> DataFrame:
    """One row ``n``: records that are past."""
    return records.agg(F.count_if(side(F.col("departs_at"), F.col("archived"), now) == "past").alias("n"))


def archive(records: DataFrame, ids: DataFrame, archived: bool = True) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return records.join(marked, "id", "left").withColumn("archived", F.when(F.col("_hit"), F.lit(archived)).otherwise(F.col("archived"))).drop("_hit")


def export_all(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One JSON line a record with its format tag; a selection where ids are given."""
    some = records if ids is None else records.join(ids.select("id"), "id", "left_semi")
    return some.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.struct(*(F.col(c) for c in records.columns)).alias("record"))).alias("line"))


def backup_header(records: DataFrame, now: int, ids: DataFrame | None = None) -> DataFrame:
    """One row ``line``: JSON of the format, when it was exported, and how many records."""
    some = records if ids is None else records.join(ids.select("id"), "id", "left_semi")
    at = F.lit(dt.datetime.fromtimestamp(now / 1000, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    return some.agg(F.count("*").alias("count")).select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), at.alias("exportedAt"), "count")).alias("line"))


def resumed(records: DataFrame, states: DataFrame, now: int, minutes: int = 30) -> DataFrame:
    """Records that fresh saved states (id, saved_at) point to."""
    fresh = states.where(F.lit(now) - F.col("saved_at") >= 0).where(F.lit(now) - F.col("saved_at") <= minutes * 60_000)
    return records.join(fresh.select("id").distinct(), "id", "left_semi")


def import_all(records: DataFrame, lines: DataFrame, replace: bool = False) -> DataFrame:
    """Rows to add from backup lines, with ``status`` added or skipped.

    Lines of another format are an error. Ids that exist are skipped unless replaced; of an id that repeats
    within the backup the last line wins, by the line's own order column if there is one.
    """
    schema = f"struct<format:string,record:struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in records.schema)}>>"
    parsed = lines.select(F.from_json("line", schema).alias("p"), F.col("ord") if "ord" in lines.columns else F.monotonically_increasing_id().alias("ord"))
    checked = parsed.select(F.when(F.col("p.format") == FORMAT, F.col("p.record")).otherwise(F.raise_error(F.lit("not a backup of this format"))).alias("r"), "ord")
    last = checked.groupBy("r.id").agg(F.max_by("r", "ord").alias("r")).select("r.*")
    have = records.select(F.col("id").alias("_have")).distinct()
    status = F.when(F.col("_have").isNull() | F.lit(replace), "added").otherwise("skipped")
    return last.join(have, F.col("id") == F.col("_have"), "left").withColumn("status", status).drop("_have")


def resume_point(state: Column, saved_at: Column, now: int, minutes: int = 30) -> Column:
    """A saved state while it is fresh."""
    return F.when((F.lit(now) - saved_at).between(0, minutes * 60_000), state)


#: What of a further leg is kept, by the end of its keys: ``leg2.origin`` and so on.
LEG_KEYS = ("origin", "destination", "flight", "date", "seat")


def _value(fields: Column, key: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["key"] == key), F.lit(0))["value"]


def _listed(text: Column) -> Column:
    """The parts of a list, if there are several."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts)


def from_draft(drafts: DataFrame, now: int, source: str = "import") -> DataFrame:
    """Records of ``schemas.TICKET`` of drafts (doc_id, kind, fields); a draft's fields are one array, so nothing is shuffled.

    Empty fields are left out. Several passengers and seats are lists besides, and further legs are structs in the order of their numbers.
    """
    filled = drafts.withColumn("_f", F.filter("fields", lambda f: f["value"].isNotNull() & (F.trim(f["value"]) != "")))
    own = F.filter("_f", lambda f: ~f["key"].rlike("^leg[0-9]+[.]"))
    origin = lambda f: F.struct(f["label"].alias("label"), f["source"].alias("source"), f["confidence"].alias("confidence"), f["edited"].alias("edited"), f["confirmed"].alias("confirmed"), f["critical"].alias("critical"))
    pairs = lambda value: F.map_from_entries(F.transform(own, lambda f: F.struct(f["key"].alias("key"), value(f).alias("value"))))
    # a cast that fails is slow, so only keys of legs are read as numbers
    number = lambda f: F.regexp_extract(f["key"], "^leg([0-9]+)[.]", 1).try_cast("int")
    numbers = lambda fs: F.array_sort(F.array_distinct(F.filter(F.transform(fs, number), lambda n: n.isNotNull())))
    named = lambda fs, name: F.get(F.filter(fs, lambda f: f["key"] == name), F.lit(0))["value"]
    of_leg = lambda fs, n, key: bound(F.concat(F.lit("leg"), n.cast("string"), F.lit(f".{key}")), lambda name: named(fs, name))
    further = F.filter("_f", lambda f: f["key"].rlike("^leg[0-9]+[.]"))
    legs = bound(further, lambda fs: F.transform(numbers(fs), lambda n: F.struct(*(of_leg(fs, n, key).alias(key) for key in LEG_KEYS))))
    some_legs = bound(legs, lambda x: F.when(F.size(x) > 0, x))
    values = pairs(lambda f: f["value"])
    return filled.select(
        F.col("doc_id").cast("string").alias("id"), "kind", values.alias("fields"), departure_timestamp(values).alias("departs_at"), F.lit(now).cast("long").alias("added_at"), F.lit(now).cast("long").alias("updated_at"),
        F.lit(source).alias("source"), F.lit(False).alias("archived"), pairs(origin).alias("provenance"), F.coalesce(_listed(_value(F.col("_f"), "passengers")), _listed(_value(F.col("_f"), "passenger"))).alias("passengers"),
        _listed(_value(F.col("_f"), "seat")).alias("all_seats"), some_legs.alias("additional_legs"),
    )


def to_draft(records: DataFrame) -> DataFrame:
    """Drafts (doc_id, kind, fields) of records, to be edited: every value is settled, at the confidence it was stored with."""
    return records.select(F.col("id").alias("doc_id"), "kind", draft_fields().alias("fields"))


def draft_fields() -> Column:
    """The fields of a record's draft, over the columns of ``schemas.TICKET``."""

    def field(key: Column, value: Column, p: Column) -> Column:
        at = lambda name, other: F.coalesce(p[name], other)
        made = new_field(key, value, at("source", F.lit("inferred")), confidence=at("confidence", F.lit("medium")), critical=at("critical", F.lit(False)))
        return made.withField("label", at("label", key)).withField("confirmed", F.lit(True)).withField("edited", at("edited", F.lit(False)))

    plain = F.transform(F.map_entries("fields"), lambda e: field(e["key"], e["value"], F.try_element_at("provenance", e["key"])))
    none = F.lit(None).cast(ORIGIN)
    leg = lambda x, i: F.filter(F.array(*(field(F.concat(F.lit("leg"), (i + 2).cast("string"), F.lit(f".{k}")), x[k], none) for k in LEG_KEYS)), lambda f: f["value"].isNotNull())
    legs = F.coalesce(F.flatten(F.transform("additional_legs", leg)), F.array().cast(FIELDS))
    return F.concat(plain.cast(FIELDS), legs.cast(FIELDS))
