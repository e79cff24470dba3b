"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts ``struct<type, text, ref, width, height, seconds, pages>``.
``flatten`` visits the parts in order: a text part becomes its escaped text; an image, audio or document
part becomes one placeholder ``<|type:k|>``, where k counts the attachments of the turn, and an entry
``struct<index, type, ref, tokens>`` with the number of tokens that the placeholder expands to:

* image: one for each started ``patch`` x ``patch`` square, at least one
* audio: ``rate`` for each started second, at least one
* document: ``page`` for each page, at least one

Unknown types count as text if they carry text, and vanish otherwise. Null fields are 0 or empty.

Turns are marked ``<|im_start|>role\\ntext<|im_end|>\\n``. Text can never hold ``<|``: each ``<``, any
number of ``\\``, ``|`` gets one more ``\\`` (``<|`` is written ``<\\|``), which is undone by taking one away.
In roles, ``\\`` and line breaks are written ``\\\\`` and ``\\n`` besides. The loss mask is an array of
[start, stop) code point spans of the formatted text, one for each assistant turn.

A null text or role is empty. Turns go by (turn, role, text), nulls first, so ties and repeated rows have
one order; a null conv_id is a conversation of its own. An empty table gives an empty table. A conversation
is one value of the result, so its turns meet in one task; nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a backslash and the character after it are read together
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _tokens(part: Column, patch: int, rate: int, page: int) -> Column:
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(float(patch)))
    image = side(part["width"]) * side(part["height"])
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0))) * rate
    document = F.coalesce(part["pages"], F.lit(0)) * page
    return F.greatest(F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(document), F.lit(1)).cast("long")


def flatten(parts: Column, patch: int = 28, rate: int = 25, page: int = 512) -> Column:
    """struct<text, attachments, tokens> of an array of PART: escaped text with placeholders, in order."""
    medium = lambda p: p["type"].isin("image", "audio", "document")
    start = F.expr("named_struct('text', '', 'attachments', cast(array() as array<struct<index:int,type:string,ref:string,tokens:bigint>>), 'tokens', cast(0 as bigint))")

    def visit(acc, p):
        index, tokens = F.size(acc["attachments"]), _tokens(p, patch, rate, page)
        entry = F.array(F.struct(index.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), tokens.alias("tokens")))
        is_medium = F.coalesce(medium(p), F.lit(False))
        return F.struct(
            F.concat(acc["text"], F.when(is_medium, F.concat(F.lit("<|"), p["type"], F.lit(":"), index.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("text"),
            F.when(is_medium, F.concat(acc["attachments"], entry)).otherwise(acc["attachments"]).alias("attachments"),
            (acc["tokens"] + F.when(is_medium, tokens).otherwise(F.lit(0))).alias("tokens"),
        )

    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as array<{PART}>)")), start, visit)


def text_parts(text: Column) -> Column:
    """The content of a plain text turn: one text part."""
    none = {"ref": "string", "width": "long", "height": "long", "seconds": "double", "pages": "long"}
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items())))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) from (conv_id, turn, role, parts)."""
    flat = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), flatten(F.col("parts")).alias("flat"))
    turn = F.struct("turn", "role", F.col("flat.text").alias("text"), F.col("flat.attachments").alias("attachments"), F.col("flat.tokens").alias("tokens"))
    rows = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _by_turn).alias("turns"))
    marked = rows.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), t["text"].alias("text"), t["role"].isin(*loss_roles).alias("loss"), t["attachments"].alias("attachments"), t["tokens"].alias("tokens"))).alias("turns"),
    )
    spans = F.expr(f"""aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,stop:bigint>>)), (acc, t) -> named_struct(
      'at', acc.at + length(t.head) + length(t.text) + {len(END) + 1},
      'spans', if(t.loss, concat(acc.spans, array(named_struct('start', acc.at + length(t.head), 'stop', acc.at + length(t.head) + length(t.text)))), acc.spans))).spans""")
    return marked.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("attachment_tokens"),
    )


def _by_turn(a: Column, b: Column) -> Column:
    order = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        order = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(order)
    return order


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts) from formatted text alone and its spans; turns: array<struct<role, text>>."""
    body = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda x: x != "")
    turn = lambda x: F.struct(
        _unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(_body(x)).alias("text"),
    )
    texts = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(body, turn).alias("turns"), texts.alias("loss_texts"))


def _body(x: Column) -> Column:
    head = F.length(F.substring_index(x, "\n", 1))
    return F.substring(x, head + 2, F.length(x) - head - F.lit(1 + len(END) + 1))
