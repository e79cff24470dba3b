"""What arrives by hand: pasted or dropped sources, OCR words, HTML without a browser, and how they are described."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udf import on_arrow
from ..operators import layout


def best_source(file: Column, html: Column, text: Column) -> Column:
    """struct<kind, content> of what is dropped or pasted: a file beats HTML beats text; blanks do not count."""
    some = lambda c: F.nullif(F.trim(c), F.lit("")).isNotNull()
    return F.struct(F.when(some(file), "file").when(some(html), "html").when(some(text), "text").alias("kind"), F.when(some(file), file).when(some(html), html).when(some(text), text).alias("content"))


def html_text_lines(html: Column) -> Column:
    """Visible text of simple HTML, a line for each block: no layout, cells of a row are two spaces apart."""
    cut = F.regexp_replace(html, r"(?is)<(script|style|head|template|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    cells = F.regexp_replace(F.regexp_replace(cut, r"[\r\n\t ]+", " "), r"(?i)</t[dh]\s*>", "  ")
    blocks = F.regexp_replace(cells, r"(?i)<br\s*/?>|</?(?:p|div|tr|li|ul|ol|table|h[1-6]|section|article|header|footer|blockquote|dl|dt|dd)\b[^>]*>", "\n")
    plain = F.regexp_replace(blocks, r"<[^>]+>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.rtrim(F.ltrim(x))), lambda x: x != ""), "\n")


def html_items(html: Column) -> Column:
    """Items of HTML on the plain-text grid, where no browser lays it out."""
    return layout.grid_items(html_text_lines(html))


@on_arrow("array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double>>")
def ocr_lines(words):
    """Lines of OCR words (text, x, y, width, height, confidence); a line is as sure as its least sure word."""
    return [{k: line[k] for k in ("text", "x", "y", "width", "height")} | {"confidence": min((i.get("confidence") or 0.0) for i in line["items"])} for line in layout.build_lines(words or [])]


def unavailable_images(images: Column) -> Column:
    """Images of a message that are remote or missing, without decoration (tiny, or named as such)."""
    decoration = lambda i: (F.coalesce(i["width"], F.lit(100)) < 24) | (F.coalesce(i["height"], F.lit(100)) < 24) | F.lower(F.coalesce(i["alt"], F.lit(""))).rlike("logo|icon|spacer|facebook|twitter|instagram|banner")
    return F.filter(images, lambda i: i["state"].isin("remote", "missing") & ~decoration(i))


def describe(kind: Column, pages: Column) -> Column:
    """What a document came from, in words."""
    count = F.when(pages > 1, F.concat(F.lit(", "), pages.cast("string"), F.lit(" pages"))).otherwise("")
    words = F.create_map(*(F.lit(x) for kv in {"pdf-text": "PDF with text", "pdf-scanned": "scanned PDF", "image": "picture", "email": "e-mail", "html": "web page", "text": "plain text", "barcode": "barcode"}.items() for x in kv))
    return F.concat(F.coalesce(words[kind], F.lit("document")), count)


def symbology(fmt: Column) -> Column:
    """The drawing library's name of a barcode format, with and without hyphens; null where none can draw it."""
    names = {"QRCODE": "qrcode", "PDF417": "pdf417", "AZTEC": "azteccode", "DATAMATRIX": "datamatrix", "CODE128": "code128", "CODE39": "code39", "EAN13": "ean13", "EAN8": "ean8", "UPCA": "upca", "ITF": "interleaved2of5"}
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.upper(F.regexp_replace(fmt, "[-_ ]", ""))]
