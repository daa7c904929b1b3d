"""Chat formatting with typed content parts.

A turn's content is an ordered array of parts (type, text, ref, units). A
visitor walks the parts of all turns in order: text parts are escaped and
inlined, image, audio and document parts become numbered placeholders, and
every placeholder records its attachment reference and the number of tokens it
expands to. One row per conversation comes out, with code-point spans of the
text that the loss covers.

Template: `<turn role="R">BODY</turn>\\n` per turn and `<TYPE N>` per
attachment, N counting from 1 in the conversation. `&` and `<` of texts are
written `&amp;` and `&lt;` (in roles `"` is `&quot;` too), so a `<` in the output is always the
template's and unescaping restores every text exactly.

Defined results: null text, null parts and empty texts are empty; a null role
is the empty role; turns sort by (turn, role, text) with null first, repeated
rows stay; a part of unknown type is a document; an attachment with null units
expands to one unit; null conversation ids form one conversation; an empty
table gives no rows. A conversation is one output string, so its turns meet in
one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolva.llm.common import let

#: Tokens that one unit of an attachment expands to (image tile, second of audio, page of a document).
UNIT_TOKENS = {"image": 170, "audio": 25, "document": 600}
PART = "struct<type:string,text:string,ref:string,units:int>"
END = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit('"'), F.lit("&quot;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&quot;"), F.lit('"')))


def text_parts(text: Column) -> Column:
    """Content with a single text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _kind(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(kind.isin("text", *UNIT_TOKENS), kind).otherwise(F.lit("document"))


def _tokens(part: Column) -> Column:
    per = F.lit(0)
    for kind, n in UNIT_TOKENS.items():
        per = F.when(_kind(part) == kind, n).otherwise(per)
    return (per * F.coalesce(part["units"], F.lit(1))).cast("long")


def _turn_piece(turn: Column) -> Column:
    """Visit one turn: its opening tag, body, and attachments; placeholders
    are numbered from the turn's own count of earlier attachments."""
    parts = F.filter(F.coalesce(turn["parts"], F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    start = F.struct(F.lit("").alias("body"), turn["before"].cast("int").alias("n"))

    def visit(acc: Column, part: Column) -> Column:
        is_text = _kind(part) == "text"
        n = acc["n"] + F.when(is_text, 0).otherwise(1)
        piece = F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), _kind(part), F.lit(" "), n.cast("string"), F.lit(">")))
        return F.struct(F.concat(acc["body"], piece).alias("body"), n.cast("int").alias("n"))

    body = F.aggregate(parts, start, visit, lambda acc: acc["body"])
    role = F.coalesce(turn["role"], F.lit(""))
    return F.struct(F.concat(F.lit('<turn role="'), escape_role(role), F.lit('">')).alias("open"),
                    body.alias("body"), (role == F.lit("assistant")).alias("learn"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts") -> DataFrame:
    """One row per conversation: formatted text, loss spans (start and end in
    code points, end excluded), attachments (n, type, ref, tokens) in order,
    number of turns, expanded token count of the attachments."""
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    files = lambda t: F.filter(F.coalesce(t["parts"], F.array().cast(f"array<{PART}>")),
                               lambda p: p.isNotNull() & (_kind(p) != "text"))
    # each turn with the number of attachments in the turns before it
    counted = F.aggregate(
        "turns", F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("n")),
        lambda acc, t: F.struct(F.concat(acc["seen"], F.array(acc["n"])).alias("seen"),
                                (acc["n"] + F.size(files(t))).cast("int").alias("n")),
        lambda acc: acc["seen"])
    convs = convs.withColumn("seen", counted)
    convs = convs.withColumn("pieces", F.transform(
        F.arrays_zip("turns", "seen"),
        lambda z: _turn_piece(F.struct(z["turns"]["role"].alias("role"), z["turns"]["parts"].alias("parts"),
                                       z["seen"].alias("before")))))
    attachments = let(F.flatten(F.transform("turns", files)), lambda found: F.transform(
        found, lambda p, i: F.struct((i + 1).alias("n"), _kind(p).alias("type"), p["ref"].alias("ref"),
                                     _tokens(p).alias("tokens"))))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["open"]) + F.length(p["body"]) + F.lit(len(END))).cast("long").alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["open"])).cast("long").alias("start"),
                (acc["at"] + F.length(p["open"]) + F.length(p["body"])).cast("long").alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return convs.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"), attachments.alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """Parse a formatted conversation back: array of (role, text), unescaped;
    placeholders stay in the text as they stand."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")
    cut = len('<turn role="')
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(F.substr(t, F.lit(cut + 1)), '">', 1)).alias("role"),
        unescape(F.substr(t, F.length(F.substring_index(t, '">', 1)) + F.lit(3))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss spans, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
