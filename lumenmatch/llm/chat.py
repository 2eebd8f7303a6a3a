"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Pixels a side of an image patch, audio tokens a second, tokens of a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Adds a backslash between ``<`` and ``|``, so that no control string is left; ``unescape`` takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _header(role: Column) -> Column:
    """Role on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(header: Column) -> Column:
    return F.replace(F.replace(unescape(header), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """One text part."""
    others = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split(":") for f in PART[7:-1].split(",")) if name not in ("kind", "text")]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *others))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; a missing size counts as one unit."""
    side = lambda name: F.ceil(F.greatest(F.coalesce(part[name], F.lit(1)), F.lit(1)) / F.lit(PATCH))
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
        .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
        .cast("long")
    )


def format_chat(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted text per conversation.

    ``messages``: conv_id, turn, role and ``parts`` (array of ``PART``; ``text_parts`` makes a plain one). A visitor turns
    the parts of a turn into text: text parts (and parts of another or no kind) are escaped, an attachment becomes
    ``<|kind:n|>`` with its number n in the conversation. Result: conv_id, formatted, loss_spans (turn: place of the turn
    from 0; offset: characters between the turn's start mark and the loss text; start: the same from the text's start;
    length) and attachments (n, turn, kind, uri, tokens).

    Defined cases: null role, text or parts are empty; turns sort by (turn, role, parts), null turns first, and repeated rows
    stay repeated turns; a null conv_id is a conversation; an empty table gives no rows. Other columns are ignored. A
    conversation's text is one value, so its turns meet in one row; conversations are spread by conv_id.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("parts")
    )
    # places of the attachments in the turn's parts
    placed = parts.withColumn("places", F.filter(F.transform("parts", lambda p, i: F.when(_is_attachment(p), i)), lambda i: i.isNotNull()))
    numbered = placed.withColumns({"first": F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)), "place": F.row_number().over(order) - 1})
    visited = numbered.select(
        "conv_id",
        "place",
        F.concat(F.lit(START), _header(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(
            F.transform(
                "parts",
                lambda p, i: F.when(_is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), (F.col("first") + F.array_position("places", i)).cast("string"), F.lit("|>"))).otherwise(
                    escape(F.coalesce(p["text"], F.lit("")))
                ),
            ),
            "",
        ).alias("body"),
        F.col("role").isin(*loss_roles).alias("loss"),
        F.transform(
            F.filter("parts", _is_attachment),
            lambda p, i: F.struct((F.col("first") + i + 1).alias("n"), F.col("place").alias("turn"), p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")),
        ).alias("attached"),
    )
    sized = visited.withColumn("turn_text", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn(
        "at", F.coalesce(F.sum(F.char_length("turn_text")).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    span = F.struct(
        F.col("place").alias("turn"),
        (F.char_length("head") - len(START)).alias("offset"),
        (F.col("at") + F.char_length("head")).alias("start"),
        F.char_length("body").alias("length"),
    )
    turns = F.array_sort(F.collect_list(F.struct("place", "turn_text", F.when(F.col("loss"), span).alias("span"), "attached")))
    grouped = sized.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("turns.turn_text"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("turns.attached")).alias("attachments"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted texts back: conv_id, turns (role, text; unescaped) and loss_text (all text under the mask, unescaped)."""
    pieces = F.slice(F.split("formatted", F.lit(START.replace("|", r"\|"))), 2, 2147483647)
    seen = formatted.withColumn("pieces", pieces)
    header = lambda p: F.substring_index(p, "\n", 1)
    return seen.select(
        "conv_id",
        F.transform(
            "pieces",
            lambda p: F.struct(
                _role(header(p)).alias("role"),
                unescape(F.substr(p, F.char_length(header(p)) + 2, F.char_length(p) - F.char_length(header(p)) - 2 - len(END))).alias("text"),
            ),
        ).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("pieces", s["turn"] + 1), s["offset"] + 1, s["length"]))), "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
