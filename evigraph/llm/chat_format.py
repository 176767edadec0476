"""Operator 3: chat formatting by a visitor over typed content parts.

A turn's content is an array of parts (type, text, ref, tokens) of type text,
image, audio or document. The visitor flattens them in order: text stays, any other
part becomes a placeholder of its type, and its reference and the tokens it will
expand to are recorded. A part of another type or none counts as text. Formatted,
a turn is

    <|im_start|>role\\n<|im_sep|>content\\n<|im_end|>\\n

Inside roles and texts every backslash is doubled and every control string gets a
backslash in front, so a text can never end or open a turn, and unescaping is to
drop each first backslash. What is escaped is the joined run of texts between two
attachments, so a control string that is spread over parts is escaped too. The loss
mask is a list of spans, in code points of the formatted string: the content of the
assistant's turns.

Only DataFrame and SQL operations. Turns are first joined in chunks of 64 turn
numbers, then chunks to conversations, so that what reaches one task for a very
long conversation is a few strings; the conversation itself is one row, as its
formatted string has to be. Places are running sums in windows on the keys of
these two groupings, so they add no shuffle and are linear in the turns.

Defined results: null text or role is empty, null parts are no parts; turns of equal
number go by role, then content; a null turn number comes first; a null conv_id is a
conversation; repeated rows are turns of their own; a very long text is kept whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of this template and of a common other one, escaped alike.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
PARTS = "array<struct<type:string,text:string,ref:string,tokens:long>>"
ATTACHED = ("image", "audio", "document")
CHUNK = 64
#: Stands for an attachment, with its type's number, while texts are joined; in a text it gets a 0 behind it.
MARK = "\ue000"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(parts: Column) -> dict[str, Column]:
    """content, attachments and expanded tokens of an array of parts."""
    attached = lambda p: F.coalesce(p["type"].isin(*ATTACHED), F.lit(False))
    marked = lambda p: F.concat(F.lit(MARK), F.array_position(F.lit(list(ATTACHED)), p["type"]).cast("string"))
    shown = F.transform(parts, lambda p: F.when(attached(p), marked(p)).otherwise(F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(MARK + "0"))))
    content = escape(F.array_join(shown, ""))
    for k, kind in enumerate(ATTACHED, 1):
        content = F.replace(content, F.lit(f"{MARK}{k}"), F.lit(f"<|{kind}|>"))
    files = F.filter(parts, attached)
    return {
        "content": F.replace(content, F.lit(MARK + "0"), F.lit(MARK)),
        "attachments": F.transform(files, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0).cast("long")).alias("tokens"))),
        "expanded": F.aggregate(files, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["tokens"], F.lit(0).cast("long"))),
    }


def text_parts(text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _before(value: Column | str, *keys: str, order: list[Column | str]) -> Column:
    """The sum of what stands before each row of a group."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask (turn, start_in_turn, start, length), attachments,
    n_turns and expanded_tokens (of the attachments), one row per conversation.
    `turns` has conv_id, turn, role and parts."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    seen = visit(F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)))
    head = F.concat(F.lit("<|im_start|>"), escape(role), F.lit("\n<|im_sep|>"))
    number = F.col("turn").cast("long")
    turn = turns.select("conv_id", number.alias("turn"), F.floor(number / CHUNK).alias("chunk"), role.alias("role"), head.alias("head"), *[c.alias(k) for k, c in seen.items()])
    rendered = F.concat("head", "content", F.lit("\n<|im_end|>\n"))
    turn = turn.select("conv_id", "chunk", "turn", "role", "content", rendered.alias("text"), F.length(rendered).cast("long").alias("n"), F.length("head").cast("long").alias("at"), F.length("content").cast("long").alias("length"), "attachments", "expanded")
    order = ["turn", "role", unescape(F.col("content"))]
    place = F.struct((F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*order)) - 1).cast("long").alias("k"), "text", "at", "length", _before("n", "conv_id", "chunk", order=order).alias("before"), F.col("role").isin(*learn).alias("learn"), "attachments")
    placed = turn.select("conv_id", "chunk", "n", "expanded", place.alias("p"))
    chunks = placed.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("n").alias("n"), F.count("*").alias("turns"), F.sum("expanded").alias("expanded"))
    spans = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["k"].alias("turn"), x["at"].alias("start_in_turn"), (x["before"] + x["at"]).alias("start"), x["length"].alias("length")))
    order = ["chunk"]
    place = F.struct(F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("k"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), spans.alias("spans"), _before("n", "conv_id", order=order).alias("before"), _before("turns", "conv_id", order=order).alias("turns_before"), F.flatten(F.transform("p", lambda x: x["attachments"])).alias("attachments"))
    convs = chunks.select("conv_id", "turns", "expanded", place.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("turns").alias("n_turns"), F.sum("expanded").alias("expanded_tokens"))
    mask = F.flatten(F.transform("p", lambda c: F.transform(c["spans"], lambda s: F.struct((s["turn"] + c["turns_before"]).alias("turn"), s["start_in_turn"].alias("start_in_turn"), (s["start"] + c["before"]).alias("start"), s["length"].alias("length")))))
    return convs.select("conv_id", F.array_join(F.transform("p", lambda c: c["text"]), "").alias("formatted"), mask.alias("loss_mask"), F.flatten(F.transform("p", lambda c: c["attachments"])).alias("attachments"), "n_turns", "expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, still escaped and without what ends them."""
    turns = F.split(formatted, r"\n<\|im_end\|>\n")
    return F.slice(turns, 1, F.size(turns) - 1)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of the roles, texts and loss text that the formatted strings and masks hold."""
    mark = F.lit("\n<|im_sep|>")
    parsed = chats.withColumn("turns", read_turns(F.col("formatted")))

    def one(t: Column) -> Column:
        cut = F.instr(t, "\n<|im_sep|>")
        role = F.substring(t, F.lit(len("<|im_start|>") + 1), cut - F.lit(len("<|im_start|>") + 1))
        content = F.substring(t, cut + F.length(mark), F.length(t))
        return F.concat(unescape(role), F.lit("\n"), unescape(content), F.lit("\n"))

    whole = F.array_join(F.transform("turns", one), "")
    learned = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.get("turns", s["turn"].cast("int")), s["start_in_turn"].cast("int") + 1, s["length"].cast("int")))), "")
    return parsed.withColumn("_learned", learned).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
