"""Files: what they are by their first bytes, what is refused, and readers of extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import looks_like_html, looks_like_message
from ..operators.layout import assess_text

# -- fixed values: limits, and what names and types of text begin or end with -----------------------------------------
MAX_BYTES, MAX_TEXT_BYTES, MAX_PAGES = 8 << 20, 4 << 20, 3
TEXT_ENDINGS = ("eml", "mht", "mhtml", "htm", "html", "txt", "msg")
TEXT_TYPES = ("message/", "text/", "application/mbox", "application/x-mimearchive")
# ----------------------------------------------------------------------------------------------------------------


def _starts(content: Column, text_hex: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(text_hex) // 2)) == text_hex


def file_kind(content: Column, path: Column, mime: Column | None = None) -> Column:
    """pdf, text, an image format, or null; PDF is looked for first, then text (by name, stated type, or first bytes), then images."""
    printable = F.regexp_count(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), F.lit(r"[\x09\x0A\x0D\x20-\x7E]"))
    textual = F.lower(path).rlike(r"\.(?:" + "|".join(TEXT_ENDINGS) + ")$") | (printable > 0.95 * F.least(F.length(content), F.lit(512)))
    if mime is not None:
        textual = F.coalesce(F.lower(mime).rlike("^(?:" + "|".join(TEXT_TYPES) + ")"), F.lit(False)) | F.coalesce(textual, F.lit(False))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    image = (
        F.when(_starts(content, "89504E47"), "png").when(_starts(content, "FFD8FF"), "jpeg").when(_starts(content, "47494638"), "gif").when(_starts(content, "424D"), "bmp")
        .when(_starts(content, "52494646") & _starts(content, "57454250", 9), "webp")
        .when(_starts(content, "66747970", 5) & brand.isin("heic", "heix", "hevc", "hevx", "mif1", "msf1", "avif", "avis"), "heif")
    )
    return F.when(F.length(content) < 4, F.lit(None)).when(_starts(content, "25504446"), "pdf").when(textual, "text").otherwise(image)


def ingest(files: DataFrame) -> DataFrame:
    """(path, content[, mime]) with ``kind``, the ``form`` of text (message, html, text) and ``refused``: why a file is not read, or null."""
    mime = F.col("mime") if "mime" in files.columns else None
    kind, size = file_kind(F.col("content"), F.col("path"), mime), F.length("content")
    text = F.decode(F.substring("content", 1, MAX_TEXT_BYTES), "UTF-8")
    form = F.when(F.col("kind") == "text", F.when(looks_like_message(text), "message").when(looks_like_html(text), "html").when(F.trim(F.translate(text, "\n\r\t", "   ")) != "", "text"))
    why = (
        F.when(F.col("content").isNull() | (size == 0), "empty").when(size > MAX_BYTES, "too-large").when(F.col("kind").isNull(), "unknown-type")
        .when((F.col("kind") == "text") & (size > MAX_TEXT_BYTES), "text-too-large").when((F.col("kind") == "text") & F.col("form").isNull(), "no-text")
    )
    return files.withColumn("kind", kind).withColumn("form", form).withColumn("refused", why)


def rejects(files: DataFrame) -> DataFrame:
    """(path, refused, size) of the files of ``ingest`` that are not read: a table beside those that are."""
    return files.where("refused IS NOT NULL").select("path", "refused", F.coalesce(F.length("content"), F.lit(0)).alias("size"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.format("binaryFile").load(path).select("path", "content"))


#: A text run: of a capture (x, y, width, height; y counts down to the baseline), or of a parser (a transform matrix; y counts up to it).
RUN = "struct<text:string,x:double,y:double,width:double,height:double,transform:array<double>>"
CAPTURE = f"name string, source string, pages array<struct<width:double,height:double,items:array<{RUN}>>>"


def _hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def runs_to_items(runs: Column, page_height: Column) -> Column:
    """Items of a page's text runs: blank ones dropped, boxes from the top down.

    A run with a matrix is as tall as its second axis and, if it has no width, as wide as its first axis times its characters.
    """

    def item(r: Column) -> Column:
        t = F.when(F.size(r["transform"]) >= 6, r["transform"])
        at = lambda k: F.get(t, F.lit(k))
        filled = lambda c: F.nullif(c, F.lit(0.0))
        height = F.coalesce(filled(_hypot(at(2), at(3))), r["height"], F.lit(0.0))
        width = F.coalesce(filled(r["width"]), _hypot(at(0), at(1)) * F.length(r["text"]), F.lit(0.0))
        y = F.when(t.isNotNull(), page_height - at(5) - height).otherwise(r["y"] - height)
        return F.struct(r["text"].alias("text"), F.coalesce(at(4), r["x"]).alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))

    return F.transform(F.filter(runs, lambda r: F.coalesce(F.trim(r["text"]) != "", F.lit(False))), item)


def read_layouts(spark: SparkSession, path: str, whole_files: bool = True, most: int = MAX_PAGES) -> DataFrame:
    """Rows (doc_id, page, width, height, items, refused) of captured layouts: JSON, a document a file or a line.

    Of each document the first ``most`` pages are made rows, before their items are touched. What is no such document is one row with
    ``refused``; a file without a name is called by its path.
    """
    texts = spark.read.text(path, wholetext=whole_files)
    parsed = texts.select(F.from_json("value", CAPTURE).alias("d"), F.col("_metadata.file_path").alias("file"))
    named = parsed.select(F.coalesce("d.name", "file").alias("doc_id"), F.when(F.coalesce(F.size("d.pages"), F.lit(0)) > 0, F.slice("d.pages", 1, most)).alias("pages"))
    each = named.select("doc_id", F.posexplode_outer("pages").alias("page", "p"))
    return each.select("doc_id", "page", "p.width", "p.height", runs_to_items(F.col("p.items"), F.col("p.height")).alias("items"), F.when(F.col("p").isNull(), "unreadable").alias("refused"))


def assessed(pages: DataFrame) -> DataFrame:
    """pages with what their text layer is worth: characters, density, has_text, partial."""
    return pages.withColumn("_a", assess_text(F.col("items"), F.col("width"), F.col("height"))).select(*pages.columns, "_a.*")


def normalise_items(items: Column, page_height: Column) -> Column:
    """Items with blank ones dropped and y turned from the baseline up to the top down."""
    kept = F.filter(items, lambda i: F.trim(i["text"]) != "")
    return F.transform(kept, lambda i: i.withField("y", page_height - i["y"] - i["height"]))


def primary_page(pages: DataFrame, assessed: str = "has_text") -> DataFrame:
    """One page a document: the first of three with text, else the first."""
    rank = F.struct(F.when(F.col(assessed), 0).otherwise(1), F.col("page"))
    rest = [c for c in pages.columns if c != "doc_id"]
    best = pages.where(F.col("page") < MAX_PAGES).groupBy("doc_id").agg(F.min_by(F.struct(*rest), rank).alias("p"))
    return best.select("doc_id", "p.*")
