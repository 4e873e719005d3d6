"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged into one block, and the
blocks are concatenated:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT of the same role<|end|>NEWLINE

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``. After doubling, the backslashes between ``<`` and
``|`` are even in number, so a single one is always the mark of an escaped control string: the escape reverses exactly.
The loss mask lists the code-point spans of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.llm.common import let, offsets

START, BODY, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation.

    loss_spans is array<struct<start:int,end:int>>, code points of ``formatted``, end exclusive, one for each text of the
    role ``learn``. Defined cases: null texts and roles are empty; a null turn comes first; rows of one turn stand in order
    of role, then text, and repeated rows are all kept; rows with a null conversation form one; an empty table gives an
    empty table; other columns are ignored.
    """
    line = F.struct(
        F.col(turn).alias("turn"),
        escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        F.coalesce(F.col(role) == learn, F.lit(False)).alias("learn"),
        F.coalesce(F.col(role), F.lit("")).alias("raw_role"),
        F.coalesce(F.col(text), F.lit("")).alias("raw_text"),
    )
    # struct order is by field: turn, then the strings as written
    ordered = F.array_sort(F.collect_list(F.struct(line["turn"].alias("turn"), line["raw_role"].alias("a"), line["raw_text"].alias("b"), line["role"].alias("role"), line["text"].alias("text"), line["learn"].alias("learn"))))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(ordered.alias("turns"))
    before = lambda i: F.get(F.col("turns"), i - 1)
    head = lambda x, i: (
        F.when(i == 0, F.concat(F.lit(START), x["role"], F.lit(BODY)))
        .when(before(i)["role"] == x["role"], F.lit(NEXT))
        .otherwise(F.concat(F.lit(END + START), x["role"], F.lit(BODY)))
    )
    pieces = grouped.select("conv_id", F.transform("turns", lambda x, i: F.struct(head(x, i).alias("head"), x["text"].alias("text"), x["learn"].alias("learn"))).alias("pieces"))
    span = lambda p, at: F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["text"])).alias("end"), p["learn"].alias("learn"))
    long_ = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["text"]))
    every = let(offsets(long_), lambda at: F.transform("pieces", lambda p, i: span(p, F.get(at, i))))
    spans = F.transform(F.filter(every, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    return pieces.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of the turns in a formatted conversation."""
    blocks = F.transform(F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != ""), lambda b: F.split(F.left(b, F.length(b) - len(END)), r"<\|text\|>", 2))
    texts = lambda b: F.split(F.get(b, F.lit(1)), r"<\|next\|>", -1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
