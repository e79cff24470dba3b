"""Registered queries of the record store, the joins and the work by group, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions.folders import shared_folder
from .operators import bands, barcode, codes, page_redaction, page_rows, quality, store, travellers
from .operators.ledger import Ledger
from .schemas import RECORD, TICKET
from .sources import files, images
from .streaming import intake


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the record store ----------------------------------------------------------------------------------------------


def store_versions(spark, sf_dir):
    """Five versions of a ledger of all orders, each read back: put, changes in order, restore, delete, undo."""
    r = catalog._records(spark, sf_dir).select("id", "kind", "fields", "departs_at", "added_at", "updated_at", "source", "archived")
    key = F.col("id").cast("long")
    book = Ledger(spark, shared_folder(spark, "ledger"), RECORD, buckets=16)
    first = book.put(r, now=1)
    change = lambda n, where, source, op: r.where(where).withColumn("source", F.lit(source)).withColumn("op", F.lit(op)).withColumn("order", F.lit(n))
    book.merge(change(1, key % 5 == 0, "first", "put").unionByName(change(2, key % 5 == 0, "second", "put")).unionByName(change(3, key % 7 == 0, "gone", "delete")), now=2)
    third = book.restore(first, now=3)
    book.delete(r.where(F.col("fields")["status"] == "F").select("id"), now=4)
    book.undo(now=5, to=third)
    out = None
    for v in book.versions():
        one = book.read(v).groupBy("source").agg(F.count("*").alias("n"), F.sum(key).alias("ids"), F.sum("updated_at").alias("stamps")).select(F.lit(v).alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out


STORE_VERSIONS_SQL = """
WITH v AS (
  SELECT 1 AS version, o_orderkey AS k, 'orders' AS source, 1 AS stamp FROM orders
  UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'orders' END, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT w, o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN 'second' ELSE 'orders' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN 2 ELSE 1 END
    FROM orders, (VALUES (3), (4), (5)) t(w) WHERE w <> 4 OR o_orderstatus <> 'F'
)
SELECT version, source, count(*) AS n, sum(k)::BIGINT AS ids, sum(stamp)::BIGINT AS stamps FROM v GROUP BY version, source"""


# -- joins ---------------------------------------------------------------------------------------------------------

HEADERS = (("Line", 40), ("Quantity", 140), ("Flag", 240), ("Status", 340))


def header_cells(spark, sf_dir):
    """Cells of all lineitem pages under the headers that they overlap; how far a cell is off its column is told by the part."""
    li = _t(spark, sf_dir, "lineitem")
    texts = (F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    off = (F.col("l_partkey") % 121 - 60).cast("double")
    cell = [F.struct((F.lit(float(x)) + off).alias("x"), F.lit(40.0).alias("width"), t.alias("text")) for t, (_, x) in zip(texts, HEADERS, strict=True)]
    cells = li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("row_id"), F.explode(F.array(*cell)).alias("c")).select("page_id", "row_id", "c.*")
    head = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(60.0).alias("width"), F.lit(name).alias("header")) for name, x in HEADERS))
    headers = li.select(F.col("l_orderkey").alias("page_id")).distinct().select("page_id", F.explode(head).alias("h")).select("page_id", "h.*")
    return bands.cells_by_header(cells, headers)


HEADER_CELLS_SQL = """
WITH c AS (
  SELECT l_orderkey AS page_id, l_linenumber AS row_id, unnest([40, 140, 240, 340]) + l_partkey % 121 - 60 AS x, unnest([l_linenumber::VARCHAR, l_quantity::INT::VARCHAR, l_returnflag, l_linestatus]) AS text FROM lineitem
), h(header, hx) AS (VALUES ('Line', 40), ('Quantity', 140), ('Flag', 240), ('Status', 340))
SELECT page_id, row_id, header, arg_max(text, (least(x + 40, hx + 60) - greatest(x, hx), -x, text)) AS text
FROM c JOIN h ON x < hx + 60 AND hx < x + 40 WHERE 100 * (least(x + 40, hx + 60) - greatest(x, hx)) > 35 * 40 GROUP BY page_id, row_id, header"""


def _code():
    """Three letters for a nation's key."""
    return F.concat(F.lit("Q"), F.char(F.pmod("n_nationkey", F.lit(26)) + 65), F.lit("X"))


def _nation_codes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(_code().alias("code"), F.col("n_name").alias("city"), F.lit(None).cast("string").alias("zone"))


def _route_lines(spark, sf_dir) -> DataFrame:
    """Lines of a page of each order: a title, one code, a code twice or two codes, and two codes the other way about."""
    o, c, n = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), _nation_codes(spark, sf_dir)
    keyed = _t(spark, sf_dir, "nation").select("n_nationkey", _code().alias("code"))
    home = o.join(c, o.o_custkey == c.c_custkey).join(keyed.withColumnRenamed("code", "a"), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    both = home.join(keyed.withColumnRenamed("code", "b"), F.col("o_orderkey") % 25 == F.col("n_nationkey"))
    plain = F.concat(F.lower("a"), F.lit("  11:30      15:30  "), F.when(F.col("o_orderkey") % 3 == 0, F.col("a")).otherwise(F.col("b")))
    lines = F.array(F.concat(F.lit("Booking "), "o_orderpriority", F.lit(" THE AIR")), F.concat(F.lit("Gate "), "a", F.lit(" NOW")), plain, F.concat(F.lit("Back "), "b", F.lit("-"), "a", F.lit(" "), "o_orderstatus", F.lit("XYZ")))
    return both.select("o_orderkey", F.posexplode(lines).alias("line", "text")).select(F.col("o_orderkey"), "line", "text")


def uncaptioned_routes(spark, sf_dir):
    """Routes of all orders' pages from two known codes on one line."""
    return codes.routes(_route_lines(spark, sf_dir), _nation_codes(spark, sf_dir), doc="o_orderkey")


UNCAPTIONED_ROUTES_SQL = """
WITH n AS (SELECT n_nationkey, 'Q' || chr(65 + n_nationkey % 26) || 'X' AS code FROM nation), p AS (
  SELECT o_orderkey, a.code AS a, b.code AS b, o_orderpriority AS p, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN n a ON c_nationkey = a.n_nationkey JOIN n b ON o_orderkey % 25 = b.n_nationkey
), l AS (
  SELECT o_orderkey, unnest([0, 1, 2, 3]) AS line, unnest(['Booking ' || p || ' THE AIR', 'Gate ' || a || ' NOW', lower(a) || '  11:30      15:30  ' || CASE WHEN o_orderkey % 3 = 0 THEN a ELSE b END, 'Back ' || b || '-' || a || ' ' || s || 'XYZ']) AS text FROM p
), w AS (
  SELECT o_orderkey, line, unnest(range(len(ws))) AS k, unnest(ws) AS code FROM (SELECT o_orderkey, line, regexp_extract_all(upper(text), '\\b[A-Z]{3}\\b') AS ws FROM l)
), d AS (
  SELECT o_orderkey, line, count(DISTINCT code) AS n, arg_min(code, k) AS origin, list_distinct(list(code ORDER BY k)) AS ds FROM w WHERE code IN (SELECT code FROM n) GROUP BY o_orderkey, line
)
SELECT o_orderkey, origin, list_filter(ds, lambda x: x <> origin)[1] AS destination, line::INT AS line FROM d WHERE n = 2 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY line) = 1""".replace("\\\\", "\\")


def person_names(spark, sf_dir):
    """Names of all customers that are no places; a fourth of them is asked by the name of their nation."""
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    asked = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(F.col("c_custkey") % 4 == 1, F.concat("n_name", F.lit(" Rao"))).otherwise(F.col("c_name")).alias("name"))
    return codes.persons(asked, "name", _nation_codes(spark, sf_dir))


PERSON_NAMES_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN n_name || ' Rao' ELSE c_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0"""


def source_outcomes(spark, sf_dir):
    """Fields of all boarding records against what their pages print: agreeing, changed, left out, and printed alone."""
    b = catalog._bcbp(spark, sf_dir)
    m = b.select(F.col("o_orderkey").alias("doc_id"), barcode.mandatory(catalog._payload()).alias("m"))
    keys = ("origin", "destination", "pnr", "flight", "seat")
    decoded = m.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.trim(F.col(f"m.{k}").cast("string")).alias("value")) for k in keys))).alias("f")).select("doc_id", "f.*")
    turn = F.col("o_orderkey")
    value = {"origin": F.col("origin"), "destination": F.lower("destination"), "pnr": F.col("pnr"), "seat": F.lpad("seat", 4, "0")}
    line = lambda k, i: F.when(turn % 5 == i, F.lit(None)).when(turn % 7 == i, F.concat(F.lit(f"{k}: Z"), value[k])).otherwise(F.concat(F.lit(f"{k}: "), value[k], F.lit(" ")))
    text = F.array_join(F.array(*(line(k, i) for i, k in enumerate(value)), F.when(turn % 3 == 0, F.concat(F.lit("terminal: T"), (turn % 4).cast("string"))), F.lit("gate: ")), "\n")
    each = b.select(turn.alias("doc_id"), F.explode(F.split(text, "\n")).alias("l"))
    printed = each.select("doc_id", F.regexp_extract("l", r"^(\w+): (.*)$", 1).alias("key"), F.regexp_extract("l", r"^(\w+): (.*)$", 2).alias("value"))
    return quality.compare_sources(decoded, printed).select("doc_id", "key", "outcome", "confidence", F.trim("other").alias("other"))


SOURCE_OUTCOMES_SQL = """
WITH p AS (
  SELECT o_orderkey AS k, rpad(upper(substr(replace(n_name, ' ', ''), 1, 3)), 3, 'X') AS origin, printf('%06d', o_orderkey % 1000000) AS pnr, lpad((o_orderkey % 60 + 1) || 'C', 4, '0') AS seat
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), f AS (
  SELECT k, unnest(range(6)) AS i, unnest(['origin', 'destination', 'pnr', 'seat', 'flight', 'terminal']) AS key, unnest([origin, 'del', pnr, seat, '', '']) AS v FROM p
), o AS (
  SELECT k, key, v, CASE WHEN i = 4 THEN 'decoded-only' WHEN i = 5 THEN 'printed-only' WHEN k % 5 = i THEN 'decoded-only' WHEN k % 7 = i THEN 'conflict' ELSE 'corroborated' END AS outcome FROM f WHERE i <> 5 OR k % 3 = 0
)
SELECT k AS doc_id, key, outcome, CASE outcome WHEN 'conflict' THEN 'low' WHEN 'printed-only' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN outcome = 'conflict' THEN 'Z' || v END AS other FROM o"""


# -- intake --------------------------------------------------------------------------------------------------------


def share_intake(spark, sf_dir):
    """The batch twin of the streaming intake: events as shared files, of which each user's first counts; what they are or why they are refused."""
    e = _t(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, "Boarding pass\nairport terminal PNR").when(kind == 1, "Train no 12 coach berth quota").when(kind == 2, F.concat(F.lit("a note on "), "event_type")).otherwise(" ")
    files = e.select(F.col("user_id").cast("string").alias("share"), F.col("event_id").cast("int").alias("place"), F.col("event_type").alias("name"), text.alias("text"), F.lit(None).cast("string").alias("payload"), F.col("ts").cast("timestamp").alias("arrived"))
    return intake.judged(files).select("share", "place", "name", "kind", "refused")


SHARE_INTAKE_SQL = """
SELECT user_id::VARCHAR AS share, event_id::INT AS place, event_type AS name, CASE event_id % 4 WHEN 0 THEN 'flight' WHEN 1 THEN 'rail' END AS kind, CASE event_id % 4 WHEN 2 THEN 'unknown-kind' WHEN 3 THEN 'empty' END AS refused
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"""


def file_kinds(spark, sf_dir):
    """All pages and all turns of conversations as files of several types: what they are, and why some are not read."""
    p, c = _t(spark, sf_dir, "pages"), _t(spark, sf_dir, "conversations")
    k = F.col("page_id") % 7
    head = lambda hex_: F.unhex(F.lit(hex_))
    body = F.when(k == 0, F.col("html").cast("binary")).when(k == 1, F.concat(head("255044462D312E37"), F.col("html").cast("binary"))).when(k == 2, F.concat(head("89504E470D0A1A0A0000"), F.col("url").cast("binary"))).when(k == 3, F.lit("").cast("binary"))
    body = body.when(k == 4, F.concat(F.lit("From: A <a@b.org>\nSubject: "), "url", F.lit("\nMIME-Version: 1.0\n\n"), "html").cast("binary")).when(k == 5, F.concat(head("00010203FFFE"), F.col("url").cast("binary"))).otherwise(F.lit(" \n \t ").cast("binary"))
    mime = F.when(k == 0, "TEXT/html").when(k == 4, "message/rfc822").when(k == 6, "text/plain")
    pages = p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), body.alias("content"), mime.alias("mime"))
    name = F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".TXT").otherwise(".bin"))
    turns = c.select(name.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.when(F.col("turn") % 2 == 1, "text/plain").alias("mime"))
    return files.ingest(pages.unionByName(turns)).select("path", "kind", "form", "refused")


FILE_KINDS_SQL = """
SELECT 'page-' || page_id AS path, CASE page_id % 7 WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' WHEN 0 THEN 'text' WHEN 4 THEN 'text' WHEN 6 THEN 'text' END AS kind, CASE page_id % 7 WHEN 0 THEN 'html' WHEN 4 THEN 'message' END AS form,
  CASE page_id % 7 WHEN 3 THEN 'empty' WHEN 5 THEN 'unknown-type' WHEN 6 THEN 'no-text' END AS refused FROM pages
UNION ALL SELECT 'turn-' || conv_id || '-' || turn || CASE WHEN turn % 2 = 0 THEN '.TXT' ELSE '.bin' END, CASE WHEN octet_length(encode(text)) >= 4 THEN 'text' END, CASE WHEN octet_length(encode(text)) >= 4 THEN CASE WHEN starts_with(text, 'From ') THEN 'message' ELSE 'text' END END,
  CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN octet_length(encode(text)) < 4 THEN 'unknown-type' END FROM conversations"""


def page_stand_ins(spark, sf_dir):
    """Conversations as pages: their names and numbers replaced by first appearance, split addresses put together."""
    c = _t(spark, sf_dir, "conversations")
    letters = F.translate((F.col("conv_id") * 3 + F.col("turn") % 3).cast("string"), "0123456789", "abcdefghij")
    number = F.lpad((F.col("conv_id") * 5 + F.col("turn") % 2 + 5000000000).cast("string"), 10, "0")
    texts = (F.concat(F.lit("Mr. Quel"), letters), F.concat(F.lit("Tel "), number, F.lit(", Quel"), letters, F.lit(" again")), F.lower(F.coalesce("text", F.lit(""))), F.concat(F.lit("quel"), letters, F.lit("@mail.")), F.lit("example.org"))
    each = c.select("conv_id", "turn", F.posexplode(F.array(*texts)).alias("k", "text"))
    items = each.select(F.col("conv_id").alias("page"), (F.col("turn") * 5 + F.col("k")).alias("item"), (F.lit(40.0) + 60 * F.col("k")).alias("x"), (F.col("turn") * 60.0 + F.col("k") % 3 * 20.0).alias("y"), "text")
    lined = items.withColumn("y", F.when(F.col("item") % 5 >= 3, F.floor(F.col("item") / 5) * 60.0).otherwise(F.col("y")))
    return page_redaction.redact_pages(lined).select("page", "item", "text")


PAGE_STAND_INS_SQL = """
WITH t AS (
  SELECT conv_id, turn, lower(coalesce(text, '')) AS text, 'Quel' || translate((conv_id * 3 + turn % 3)::VARCHAR, '0123456789', 'abcdefghij') AS name, (conv_id * 5 + turn % 2 + 5000000000)::VARCHAR AS number FROM conversations
), n AS (
  SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), upper(name)) - 1 AS k FROM t GROUP BY conv_id, name
), d AS (
  SELECT conv_id, number, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS k FROM t GROUP BY conv_id, number
), w AS (
  SELECT t.*, (['SAMPLE', 'TRAVELLER', 'PERSON', 'GUEST'])[n.k % 4 + 1] || CASE WHEN n.k >= 4 THEN n.k::VARCHAR ELSE '' END AS stand_in, 1234567890 + 111111 * d.k AS digits
  FROM t JOIN n USING (conv_id, name) JOIN d USING (conv_id, number)
), p AS (
  SELECT *, length(name) + 6 AS a FROM w
)
SELECT conv_id AS page, turn * 5 + unnest([0, 1, 2, 3, 4]) AS item,
  unnest(['Mr. ' || stand_in, 'Tel ' || digits || ', ' || stand_in || ' again', text, substr('traveller@example.com', 1, round(a / (a + 11) * 21)::INT), substr('traveller@example.com', round(a / (a + 11) * 21)::INT + 1)]) AS text FROM p"""


def _messages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages whose links stand as images, and the parts that some of them name."""
    links = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"))

    def tag(href, i):
        k = i % 5
        src = F.when(k == 0, F.concat(F.lit("cid:part%20"), i.cast("string"))).when(k == 1, F.concat(F.lit("http://img.example"), href, F.lit("?a&gt;b"))).when(k == 2, "data:image/png;base64,AAAA").when(k == 3, F.concat(F.lit("CID:gone"), i.cast("string"))).otherwise("")
        alt = F.when(i % 3 == 0, "your barcode > here").when(i % 7 == 1, "logo").otherwise("")
        w, h = 40 + (F.length(href) * 37 + i * 53) % 400, 30 + (F.length(href) * 19 + i * 71) % 300
        return F.concat(F.lit('<IMG border=0 src="'), src, F.lit("\" alt='"), alt, F.lit("' width="), w.cast("string"), F.lit(' height="'), h.cast("string"), F.lit('px"><p>x</p>'))

    pages = links.select("doc_id", F.array_join(F.transform("links", tag), "\n").alias("html"))
    parts = links.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.size("links"), F.lit(1)))).alias("i")).where("i % 10 = 0")
    return pages, parts.select("doc_id", F.concat(F.lit("<part "), F.col("i").cast("string"), F.lit(">")).alias("key"), F.lit("image/png").alias("content_type"), F.col("i").cast("long").alias("size"))


_IMAGES_SQL = """
WITH l AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages), i AS (
  SELECT doc_id, unnest(range(len(links)))::INT AS ord, length(unnest(links)) AS n FROM l
), t AS (
  SELECT doc_id, ord, 40 + (n * 37 + ord * 53) % 400 AS w, 30 + (n * 19 + ord * 71) % 300 AS h, ord % 3 = 0 AS code, ord % 3 <> 0 AND ord % 7 = 1 AS logo FROM i
), s AS (
  SELECT *, CASE WHEN w >= 48 AND h >= 24 THEN CASE WHEN w / h > 0.8 AND w / h < 1.25 THEN 50 WHEN w / h BETWEEN 2.5 AND 9 THEN 35 ELSE -20 END + least(25, floor(w * h / 12000 + 0.5)) - CASE WHEN w * h < 8000 THEN 25 ELSE 0 END
    + CASE WHEN code THEN 30 ELSE 0 END - CASE WHEN logo THEN 40 ELSE 0 END END::INT AS score FROM t
)
"""


def image_candidates(spark, sf_dir):
    """The six images of each page that may best hold a barcode."""
    return images.candidates(images.image_tags(_messages(spark, sf_dir)[0])).select("doc_id", "ord", "score", "rank")


IMAGE_CANDIDATES_SQL = _IMAGES_SQL + "SELECT doc_id, ord, score, (row_number() OVER w)::INT AS rank FROM s WHERE score >= 10 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, ord) QUALIFY rank <= 6"


def image_states(spark, sf_dir):
    """What each image of each page resolves to."""
    pages, parts = _messages(spark, sf_dir)
    return images.resolve(images.image_tags(pages), parts).select("doc_id", "ord", "state", "content_type", "width")


IMAGE_STATES_SQL = _IMAGES_SQL + """
SELECT doc_id, ord, CASE ord % 5 WHEN 0 THEN CASE WHEN ord % 10 = 0 THEN 'embedded' ELSE 'missing' END WHEN 1 THEN 'remote' WHEN 2 THEN 'inline' WHEN 3 THEN 'missing' ELSE 'none' END AS state,
  CASE WHEN ord % 10 = 0 THEN 'image/png' END AS content_type, w::INT AS width FROM s"""


def traveller_names(spark, sf_dir):
    """Names of all orders' lines, without repeats and longer forms of names that are there."""
    li = _t(spark, sf_dir, "lineitem")
    pick = lambda of, *words: F.element_at(F.array(*(F.lit(w) for w in words)), (F.col(of) % len(words) + 1).cast("int"))
    name = F.concat(pick("l_partkey", "Asha", "ASHA", "Ravi"), pick("l_suppkey", "", " Rao", "  rao Kumar", " Raoul", " Iyer"))
    return travellers.distinct_names(li.select("l_orderkey", "l_linenumber", name.alias("name")), doc="l_orderkey", position="l_linenumber")


TRAVELLER_NAMES_SQL = """
WITH n AS (
  SELECT l_orderkey, l_linenumber AS p, replace((['Asha', 'ASHA', 'Ravi'])[l_partkey % 3 + 1] || (['', ' Rao', '  rao Kumar', ' Raoul', ' Iyer'])[l_suppkey % 5 + 1], '  ', ' ') AS name FROM lineitem
), k AS (
  SELECT l_orderkey, upper(name) AS key, min((p, name)) AS f FROM n GROUP BY ALL
), r AS (
  SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.l_orderkey = k.l_orderkey AND starts_with(k.key, o.key || ' '))
)
SELECT r.l_orderkey, any_value(r.f[2]) AS name, min(k.f[1]) AS l_linenumber FROM r JOIN k ON r.l_orderkey = k.l_orderkey AND (k.key = r.key OR starts_with(k.key, r.key || ' ')) GROUP BY r.l_orderkey, r.key"""


# -- layouts and drafts --------------------------------------------------------------------------------------------


def page_lines(spark, sf_dir):
    """Lines and cells of all lineitem pages: items a little off their line, and next to or apart from each other."""
    li = _t(spark, sf_dir, "lineitem")
    off, gap = (F.col("l_partkey") % 3).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    number = lambda k: F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.lit(k))
    item = lambda k, text, x: F.struct(number(k).alias("item"), text.alias("text"), x.alias("x"), (F.lit(14.0) * F.col("l_linenumber") + off * k).alias("y"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"))
    row = F.array(item(0, F.col("l_returnflag"), F.lit(40.0)), item(1, F.col("l_linestatus"), F.lit(70.0) + gap), item(2, F.lit(" "), F.lit(500.0)), item(2, F.col("l_linenumber").cast("string"), F.lit(200.0)))
    items = li.select(F.col("l_orderkey").alias("page"), F.explode(row).alias("i")).select("page", "i.*")
    return page_rows.line_boxes(page_rows.with_cells(page_rows.with_lines(items)))


PAGE_LINES_SQL = """
WITH i AS (
  SELECT l_orderkey AS page, row_number() OVER () * 3 + unnest([0, 1, 2]) AS id, unnest([40, 70 + l_suppkey % 20, 200])::DOUBLE AS x, 14.0::DOUBLE * l_linenumber + unnest([0, 1, 2]) * (l_partkey % 3) AS y FROM lineitem
), l AS (
  SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x, id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x, id) > 5.5 THEN 1 ELSE 0 END AS new FROM i)
), c AS (
  SELECT *, CASE WHEN x - max(x + 30) OVER (PARTITION BY page, line ORDER BY x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10.5 THEN 1 ELSE 0 END AS cut FROM l
)
SELECT page, line, count(*) AS n, (sum(cut) + 1)::BIGINT AS cells, min(x) AS x, min(y) AS y, max(x) + 30 - min(x) AS width, max(y) + 10 - min(y) AS height FROM c GROUP BY page, line"""


def captured_layouts(spark, sf_dir):
    """All orders' layouts, written as JSON and read by their source: the page that counts, and its items' boxes.

    Of two pages in three the first has too little text; runs carry a matrix or a box, and a third of the documents is none.
    """
    o, path = _t(spark, sf_dir, "orders"), shared_folder(spark, "layouts")
    k = F.col("o_orderkey")
    size = (k % 5 + 1).cast("double")
    long = F.concat(F.lit("A page of a ticket with enough text to be read, order "), k.cast("string"), F.lit(" "), "o_orderpriority")
    no = F.lit(None).cast("double")
    run = lambda text, x, y, width, height, matrix: F.struct(text.alias("text"), x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), matrix.alias("transform"))
    boxed = lambda text: run(text, F.lit(40.0), F.lit(120.0) + size, F.lit(200.0), size * 2, F.lit(None).cast("array<double>"))
    turned = lambda text: run(text, no, no, no, no, F.array(size * 3, size * 4, size * 6, size * 8, F.lit(55.0), F.lit(100.0)))
    page = lambda *runs: F.struct(F.lit(100.0).alias("width"), F.lit(300.0).alias("height"), F.array(*runs).alias("items"))
    first = page(boxed(F.when(k % 3 == 0, long).otherwise("short")), boxed(F.lit("  ")))
    pages = F.array(first, page(turned(long), boxed(F.lit("end"))), page(boxed(long)), page(boxed(F.lit("beyond"))))
    line = F.when(k % 3 == 2, F.concat(F.lit("no JSON "), k.cast("string"))).otherwise(F.to_json(F.struct(k.cast("string").alias("name"), F.lit("pdf").alias("source"), pages.alias("pages"))))
    o.select(line.alias("value")).write.text(path)
    read = files.assessed(files.read_layouts(spark, path, whole_files=False).where("refused IS NULL"))
    best = files.primary_page(read)
    box = F.col("items")[0]
    return best.select("doc_id", F.col("page").cast("int").alias("page"), F.size("items").alias("n"), box["x"].alias("x"), box["y"].alias("y"), F.round(box["width"], 3).alias("width"), box["height"].alias("height"), "characters", "has_text")


CAPTURED_LAYOUTS_SQL = """
WITH o AS (
  SELECT o_orderkey AS k, (o_orderkey % 5 + 1)::DOUBLE AS s, length('A page of a ticket with enough text to be read, order ' || o_orderkey || ' ' || o_orderpriority) AS n FROM orders WHERE o_orderkey % 3 <> 2
)
SELECT k::VARCHAR AS doc_id, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS page, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN k % 3 = 0 THEN 40.0 ELSE 55.0 END::DOUBLE AS x,
  CASE WHEN k % 3 = 0 THEN 120 + s - 2 * s ELSE 200 - 10 * s END AS y, CASE WHEN k % 3 = 0 THEN 200 ELSE 5 * s * n END::DOUBLE AS width, CASE WHEN k % 3 = 0 THEN 2 * s ELSE 10 * s END AS height,
  (n + CASE WHEN k % 3 = 0 THEN 0 ELSE 3 END)::BIGINT AS characters, (n + CASE WHEN k % 3 = 0 THEN 0 ELSE 3 END) / (100 / 72.0 * 2.54 * 300 / 72.0 * 2.54) >= 0.5 AS has_text FROM o"""


def draft_round_trip(spark, sf_dir):
    """Drafts of all orders, each with two further legs and its passengers, stored in a ledger, read back and opened again."""
    o = catalog._dealt(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    field = lambda key, value, source, critical=False: quality.new_field(F.lit(key), value, F.lit(source), critical=critical)
    made = [
        field("origin", F.lit("DEL"), "barcode", True), field("date", F.date_format("o_orderdate", "yyyy-MM-dd"), "pdf-text", True), field("pnr", F.concat(F.lit("P"), k.cast("string")), "ocr"), field("gate", F.lit(" "), "ocr"),
        field("passengers", F.when(k % 2 == 0, F.concat(F.lit("Asha Rao, C"), F.col("o_custkey").cast("string"))).otherwise("Asha Rao"), "barcode"), field("seat", F.when(k % 3 == 0, F.lit("1A, 1B, 2C")).otherwise("1A"), "barcode"),
        field("leg3.origin", F.lit("GOI"), "barcode"), field("leg2.origin", F.when(k % 4 > 0, F.lit("BOM")), "barcode"), field("leg2.flight", F.concat(F.lit("AI "), (k % 900).cast("string")), "barcode"),
    ]
    drafts = o.select(k.alias("doc_id"), F.lit("flight").alias("kind"), F.array(*made).alias("fields"))
    book = Ledger(spark, shared_folder(spark, "drafts"), TICKET, buckets=16)
    book.put(store.from_draft(drafts, now=1), now=2)
    kept = book.read()
    f = lambda key: F.get(F.filter("drafted", lambda x: x["key"] == key), F.lit(0))
    opened = kept.withColumn("drafted", store.draft_fields())  # beside the record, so that no join brings them together
    return opened.select(
        F.col("id").alias("doc_id"), F.size("drafted").alias("n"), F.size(F.filter("drafted", lambda x: x["confirmed"])).alias("settled"), f("pnr")["confidence"].alias("sure"), f("leg2.flight")["value"].alias("flight2"), f("leg3.origin")["value"].alias("origin3"),
        "departs_at", F.size(F.coalesce("passengers", F.array())).alias("passengers"), F.array_join("all_seats", "+").alias("seats"), F.get("additional_legs", F.lit(0))["origin"].alias("origin2"),
    )


DRAFT_ROUND_TRIP_SQL = """
SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 4 > 0 THEN 8 ELSE 7 END AS n, CASE WHEN o_orderkey % 4 > 0 THEN 8 ELSE 7 END AS settled, 'low' AS sure, 'AI ' || o_orderkey % 900 AS flight2, 'GOI' AS origin3,
  epoch_ms(o_orderdate::DATE::TIMESTAMP) AS departs_at, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS passengers, CASE WHEN o_orderkey % 3 = 0 THEN '1A+1B+2C' END AS seats, CASE WHEN o_orderkey % 4 > 0 THEN 'BOM' END AS origin2 FROM orders"""


QUERIES = {f.__name__: f for f in (store_versions, header_cells, uncaptioned_routes, person_names, source_outcomes, share_intake, page_stand_ins, image_candidates, image_states, traveller_names, captured_layouts, draft_round_trip, page_lines, file_kinds)}
ORACLES = {
    "store_versions": STORE_VERSIONS_SQL, "header_cells": HEADER_CELLS_SQL, "uncaptioned_routes": UNCAPTIONED_ROUTES_SQL, "person_names": PERSON_NAMES_SQL, "source_outcomes": SOURCE_OUTCOMES_SQL,
    "share_intake": SHARE_INTAKE_SQL, "page_stand_ins": PAGE_STAND_INS_SQL, "image_candidates": IMAGE_CANDIDATES_SQL, "image_states": IMAGE_STATES_SQL, "traveller_names": TRAVELLER_NAMES_SQL, "page_lines": PAGE_LINES_SQL, "file_kinds": FILE_KINDS_SQL, "captured_layouts": CAPTURED_LAYOUTS_SQL, "draft_round_trip": DRAFT_ROUND_TRIP_SQL,
}
