"""E-mail messages: headers, multiparts, encodings, and what HTML may keep.

``parse`` is a plain function on one message; ``messages`` runs it in Arrow batches. Multiparts nest up to
eight deep; the first HTML and the first plain text that are not attachments win.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udf import on_arrow
from ..schemas import EMAIL

DEPTH = 8
# -- fixed values: elements that are removed with what is in them, and those of them that have no end tag ----------
DROPPED = frozenset("script iframe object embed applet frame frameset link base form input button noscript".split())
EMPTY = frozenset("embed frame link base input".split())
ADDRESSES = frozenset("href src xlink:href action formaction srcset background poster".split())
# -----------------------------------------------------------------------------------------------------------------
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")


def quoted_printable(text: str) -> bytes:
    """Bytes of quoted-printable text; a stray = stays."""
    out = re.sub(r"=[ \t]*\r?\n", "", text).encode("utf-8")
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), out)


def from_base64(text: str) -> bytes:
    """Bytes of base64 text; invalid text gives none."""
    try:
        return base64.b64decode(re.sub(r"\s+", "", text), validate=True)
    except (binascii.Error, ValueError):
        return b""


def to_text(data: bytes, charset: str | None) -> str:
    for name in (charset or "utf-8", "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("windows-1252", "replace")


def decode_words(text: str) -> str:
    """Encoded words of a header; white space between two of them goes."""
    joined = re.sub(r"(\?=)\s+(=\?)", r"\1\2", text)
    return _WORD.sub(lambda m: to_text(from_base64(m[3]) if m[2] in "bB" else quoted_printable(m[3].replace("_", " ")), m[1]), joined)


def split_headers(raw: str) -> tuple[dict[str, str], str]:
    """(unfolded headers, the first of a name wins; body)."""
    raw = raw.replace("\r\n", "\n")
    head, _, body = raw.partition("\n\n")
    headers: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    return headers, body


def parameters(value: str) -> tuple[str, dict[str, str]]:
    """(main value, parameters) of a header; continued parameters are joined, sorted by their written name."""
    main, *rest = re.findall(r'(?:[^;"]|"[^"]*")+', value) or [""]
    found: dict[str, str] = {}
    for part in rest:
        name, eq, v = part.partition("=")
        if eq:
            found[name.strip().lower()] = v.strip().strip('"')
    out = {k: v for k, v in found.items() if "*" not in k}
    for base in {k.split("*")[0] for k in found if "*" in k} - set(out):
        text = "".join(found[k] for k in sorted(found) if k.split("*")[0] == base)
        charset, quote, coded = text.partition("''")
        out[base] = to_text(re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), coded.encode()), charset) if quote else text
    return main.strip().lower(), out


def _parts(raw: str, depth: int = 0):
    headers, body = split_headers(raw)
    kind, params = parameters(headers.get("content-type", "text/plain"))
    if kind.startswith("multipart/") and params.get("boundary") and depth < DEPTH:
        chunks = re.split(rf"(?:^|\n)--{re.escape(params['boundary'])}(?:--)?[ \t]*(?:\n|$)", body)
        for chunk in chunks[1:]:
            if chunk.strip():
                yield from _parts(chunk, depth + 1)
        return
    coding = headers.get("content-transfer-encoding", "").strip().lower()
    data = quoted_printable(body) if coding == "quoted-printable" else from_base64(body) if coding == "base64" else body.encode("utf-8", "surrogateescape")
    disposition, about = parameters(headers.get("content-disposition", ""))
    name = about.get("filename") or params.get("name")
    yield {"kind": kind, "charset": params.get("charset"), "name": decode_words(name) if name else None, "disposition": disposition, "id": headers.get("content-id", "").strip("<> ") or None, "location": headers.get("content-location"), "data": data}


def parse(raw: str | None) -> dict | None:
    if raw is None:
        return None
    headers, _ = split_headers(raw)
    sender = decode_words(headers.get("from", ""))
    m = re.match(r'^\s*"?([^"<]*?)"?\s*<([^>]*)>', sender)
    address = m[2] if m else sender.strip()
    out = {"subject": decode_words(headers.get("subject", "")) or None, "from_name": (m[1].strip() or None) if m else None, "from_domain": address.rpartition("@")[2].lower() if "@" in address else None, "html": None, "text": None, "attachments": [], "resources": []}
    for part in _parts(raw):
        if part["kind"].startswith("image/"):
            keys = [k for k in (part["id"], part["location"], part["name"]) if k]
            out["resources"].append({"key": keys[0] if keys else "", "content_type": part["kind"], "size": len(part["data"])})
        elif part["disposition"] == "attachment" or part["kind"] in ("application/pdf", "application/vnd.apple.pkpass", "message/rfc822"):
            out["attachments"].append({"name": part["name"] or "", "content_type": part["kind"], "size": len(part["data"])})
        elif part["kind"] == "text/html" and out["html"] is None:
            out["html"] = to_text(part["data"], part["charset"])
        elif part["kind"] == "text/plain" and out["text"] is None:
            out["text"] = to_text(part["data"], part["charset"])
    return out


@on_arrow(EMAIL)
def messages(raw):
    """struct EMAIL of raw messages."""
    return parse(raw) or dict.fromkeys(("subject", "from_name", "from_domain", "html", "text"), None) | {"attachments": [], "resources": []}


#: Stands for & while a page is cleaned, so that references come out as they went in.
_AMPERSAND = "\ue0ff"
_ACTIVE = re.compile(r"(?i)[\s\x00-\x20]*(?:javascript|vbscript|data:text/html)")


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs, closed=False):
        if self.skip or tag in DROPPED:
            if tag in DROPPED and tag not in EMPTY and not closed:
                self.skip.append(tag)
            return
        a = dict(attrs)
        if tag == "meta" and re.search(r"(?i)refresh|content-security-policy", a.get("http-equiv") or ""):
            return
        kept = [(k, v) for k, v in attrs if not k.lower().startswith("on") and not (k.lower() in ADDRESSES and _ACTIVE.match(html.unescape((v or "").replace(_AMPERSAND, "&"))))]
        self.out.append("<" + tag + "".join(f' {k}="{(v or "").replace(chr(34), "&quot;")}"' for k, v in kept) + ("/>" if closed else ">"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in DROPPED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def sanitise(text: str | None) -> str | None:
    """HTML without active elements, event attributes, script addresses, refreshes and policies."""
    if text is None:
        return None
    c = _Cleaner()
    c.feed(text.replace("&", _AMPERSAND))
    c.close()
    return "".join(c.out).replace(_AMPERSAND, "&")


@on_arrow("string")
def sanitise_html(page):
    return sanitise(page)


def best_part(attachments: Column, html: Column, text: Column) -> Column:
    """What of a message is read: a PDF, else the first attachment, else HTML, else text."""
    pdf = F.get(F.filter(attachments, lambda a: (a["content_type"] == "application/pdf") | F.lower(a["name"]).endswith(".pdf")), F.lit(0))
    first = F.get(attachments, F.lit(0))
    return F.when(pdf.isNotNull(), F.concat(F.lit("attachment:"), pdf["name"])).when(first.isNotNull(), F.concat(F.lit("attachment:"), first["name"])).when(html.isNotNull(), "html").when(text.isNotNull(), "text")
