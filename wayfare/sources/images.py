"""Images of messages and pages: their tags, what they resolve to, and which may hold a barcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.barcode import image_score

#: Images of a message that are tried, and the score below which one is decoration.
MOST, LEAST_SCORE = 6, 10
#: A tag up to its end; a > inside quotes is not it.
TAG = r"""(?is)<img\b(?:[^>"']|"[^"]*"|'[^']*')*>"""


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty if it is not there."""
    rest = rf"""(?is)^<img\b(?:[^>"']|"[^"]*"|'[^']*')*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    found = F.array(*(F.regexp_extract(tag, rest, k) for k in (1, 2, 3)))
    plain = F.array_max(found)  # at most one of them is not empty
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def image_tags(pages: DataFrame, html: str = "html", doc: str = "doc_id") -> DataFrame:
    """(doc, ord, src, alt, width, height) of every <img> of a page, in order; sizes that are no numbers are null."""
    tags = pages.select(doc, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(0))).alias("ord", "tag"))
    size = lambda name: F.regexp_extract(attribute(F.col("tag"), name), r"^\s*([0-9]{1,6})(?:\.[0-9]*)?\s*(?:px)?\s*$", 1).try_cast("int")
    return tags.select(doc, "ord", attribute(F.col("tag"), "src").alias("src"), attribute(F.col("tag"), "alt").alias("alt"), size("width").alias("width"), size("height").alias("height"))


def resource_key(address: Column) -> Column:
    """One form of what names a part of a message: without cid: and angle brackets, and with escapes decoded."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(address), r"(?i)^cid:", ""), r"^<(.*)>$", "$1")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def resolve(images: DataFrame, resources: DataFrame, doc: str = "doc_id") -> DataFrame:
    """images with ``state`` and the ``content_type`` of the part: inline, embedded, remote, missing, or none without an address.

    resources: (doc, key, content_type, size). Keys on both sides are brought to one form; of parts with one key the first by content
    type and size counts. Images without a part stay, so nothing is loaded that the message does not hold.
    """
    parts = resources.where(F.col("key").isNotNull()).select(F.col(doc).alias("_doc"), resource_key(F.col("key")).alias("_key"), F.struct("content_type", "size").alias("_part"))
    known = parts.groupBy("_doc", "_key").agg(F.min("_part").alias("_part"))
    met = images.join(known, F.col(doc).eqNullSafe(F.col("_doc")) & (resource_key(F.col("src")) == F.col("_key")), "left")
    src = F.lower(F.trim("src"))
    state = F.when(src == "", "none").when(src.startswith("data:"), "inline").when(F.col("_part").isNotNull(), "embedded").when(src.rlike("^https?:"), "remote").otherwise("missing")
    return met.select(*(F.col(c) for c in images.columns), state.alias("state"), F.when(state == "embedded", F.col("_part.content_type")).alias("content_type"))


def candidates(images: DataFrame, most: int = MOST, least: int = LEAST_SCORE, doc: str = "doc_id") -> DataFrame:
    """The images of each message that may hold a barcode, best first: ``score`` and ``rank``, from 1; equal scores in order.

    Spark keeps ``most`` rows a message in every task before they are shuffled, so a message of any number of images is not gathered.
    """
    address = F.when(F.lower("src").rlike("^https?:"), F.col("src")).otherwise("")
    scored = images.withColumn("score", image_score(F.col("width"), F.col("height"), F.col("alt"), address)).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= most)
