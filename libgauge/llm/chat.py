"""Chat formatting from typed content parts, in DataFrame expressions only.

A conversation's rows become one formatted text.  A visitor, one rule for each part type,
flattens text, image, audio and document parts into ordered placeholders and records what each
placeholder stands for and how many tokens it will expand to.

Template of a turn:  ``<|turn|>`` role ``\\n`` body ``<|end|>\\n``.  In roles and texts ``&``,
``<`` and ``[`` are written as entities, so no text can hold a control string, ours or that of
another template, and reading back restores every text exactly.

Defined results: a null text or role counts as empty; rows of a conversation are ordered by turn
(null first), then role, then body, so ties and repeated rows are all kept in a fixed order; rows
with a null conversation id form one conversation; an empty table gives an empty result; other
columns are ignored.  A conversation of any length is built from blocks of BLOCK_TURNS turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_TURNS = 512
TURN, END = "<|turn|>", "<|end|>\n"
TURN_PATTERN = r"<\|turn\|>"
#: How texts are escaped, in this order; reading back undoes it from the last to the first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ATTACHED = ("image", "audio", "document")
#: Schema of a content part; fields that a type doesn't use are null.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


class Visitor:
    """One method for each part type: each gives what the part turns into and its token count."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def text(self, part: Column, at: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def placeholder(self, part: Column, at: Column) -> Column:
        return F.concat(F.lit("<|"), part["type"], F.lit(":"), at, F.lit("|>"))

    def image_tokens(self, part: Column) -> Column:
        side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(float(self.patch)))
        return side(part["width"]) * side(part["height"])

    def audio_tokens(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(self.audio_rate))

    def document_tokens(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(0)).cast("long") * F.lit(self.page_tokens)

    def visit(self, part: Column, at: Column) -> Column:
        """Parts of an unknown or null type are flattened as text."""
        kind = part["type"]
        tokens = F.when(kind == "image", self.image_tokens(part)).when(kind == "audio", self.audio_tokens(part)).when(kind == "document", self.document_tokens(part)).otherwise(F.lit(0))
        return F.struct(
            F.coalesce(kind, F.lit("text")).alias("type"),
            F.when(kind.isin(*ATTACHED), self.placeholder(part, at)).otherwise(self.text(part, at)).alias("rendered"),
            part["uri"].alias("uri"),
            tokens.cast("long").alias("tokens"),
        )


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    parts_col: str | None = None, loss_role: str = "assistant", visitor: Visitor | None = None, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per conversation: conv_id, chunks, attachments, attachment_tokens.

    ``chunks`` is the formatted text in pieces, each with the spans (0-based start and length in
    code points) of its loss mask; ``formatted`` joins them.  ``attachments`` lists, in order, the
    parts that stand behind placeholders.
    """
    visitor = visitor or Visitor()
    part = F.struct(F.lit("text").alias("type"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))) if parts_col is None else None
    parts = F.array(part) if part is not None else F.coalesce(F.col(f"`{parts_col}`").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), parts.alias("parts"),
    )
    # Rows of one conversation and turn are told apart in placeholders, where a null turn reads -1.
    written = F.coalesce(F.col("turn"), F.lit(-1).cast("long"))
    again = F.lit(1) if parts_col is None else F.row_number().over(Window.partitionBy("conv_id", written).orderBy(F.asc_nulls_first("turn"), "role", "parts"))
    rows = rows.withColumn("again", again)
    turn = F.concat(written.cast("string"), F.when(F.col("again") > 1, F.concat(F.lit("~"), F.col("again").cast("string"))).otherwise(""))
    place = lambda i: F.concat_ws(".", turn, i.cast("string"))
    flat = rows.withColumn("flat", F.transform("parts", lambda p, i: visitor.visit(p, place(i))))
    body = F.array_join(F.transform("flat", lambda x: x["rendered"]), "")
    shown = flat.select(
        "conv_id", F.floor(F.col("turn") / F.lit(block_turns)).alias("block"),  # null, and so first, for a null turn
        F.struct(
            F.col("turn"), F.col("role"), body.alias("body"),
            F.filter(F.transform("flat", lambda x, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), x["type"].alias("type"), x["uri"].alias("uri"), x["tokens"].alias("tokens"))), lambda x: x["type"].isin(*ATTACHED)).alias("attachments"),
        ).alias("line"),
    )
    blocks = shown.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    head = lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n"))
    spans = F.aggregate(
        "lines",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["body"]) + F.lit(len(END))).alias("at"),
            F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t))).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    pieces = blocks.select(
        "conv_id",
        F.struct(
            F.col("block"), F.array_join(F.transform("lines", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("text"),
            spans.alias("spans"), F.flatten(F.transform("lines", lambda t: t["attachments"])).alias("attachments"),
        ).alias("piece"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    attachments = F.flatten(F.transform("pieces", lambda p: p["attachments"]))
    return whole.select(
        "conv_id", F.transform("pieces", lambda p: F.struct(p["text"].alias("text"), p["spans"].alias("spans"))).alias("chunks"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("attachment_tokens"),
    )


def formatted(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c: c["text"]), "")


def read_turns(chunks: Column) -> Column:
    """The turns as they stand in the formatted text: array<struct<role, text>>, unescaped."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = F.length(role) + F.lit(2)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(piece, start, F.length(piece) - F.length(role) - F.lit(1 + len(END)))).alias("text"))

    return F.flatten(F.transform(chunks, lambda c: F.transform(F.filter(F.split(c["text"], TURN_PATTERN), lambda x, i: i > 0), turn)))


def read_loss(chunks: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.flatten(F.transform(chunks, lambda c: F.transform(c["spans"], lambda s: unescape(F.substring(c["text"], s["start"] + F.lit(1), s["length"]))))), "")


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    read = format_chats(rows.unionByName(case)).select("conv_id", read_turns(F.col("chunks")).alias("turns"), read_loss(F.col("chunks")).alias("loss"), formatted(F.col("chunks")).alias("formatted"), "attachment_tokens")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "attachment_tokens",
    )


#: DuckDB: the digests from the rows themselves; the formatted length from the template's parts.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS shown
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(shown) + length(body))::BIGINT AS formatted_chars,
  0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
