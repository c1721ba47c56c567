r"""Operator 10, chat formatting with Spark expressions only.

Template: every run of adjacent turns with the same role is one block,

    <|im_start|>role\ntext<|im_sep|>text...<|im_end|>\n

so that merged turns can be told apart again. Inside roles and texts each ``<``,
any number of ``~``, ``|`` gets one more ``~``, so that no control string can occur;
a line break inside a role is ``<|im_nl|>``. ``unescaped`` reverses that exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_nl|>"
#: Turns of one conversation that are gathered before they meet its other turns.
SEGMENT_TURNS = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def _merged(rows: DataFrame) -> DataFrame:
    """``blocks`` (an array of role, texts) with adjacent blocks of the same role as one."""
    blocks, starts = F.col("blocks"), F.col("_starts")
    first_of_run = F.filter(
        F.sequence(F.lit(0), F.size(blocks) - 1),
        lambda i: (i == 0) | (F.get(blocks, i).role != F.get(blocks, i - 1).role),
    )

    def run(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get(starts, k + 1), F.size(blocks)) - start
        texts = F.transform(F.slice(blocks, start + 1, length), lambda b: b.texts)
        return F.struct(F.get(blocks, start).role.alias("role"), F.flatten(texts).alias("texts"))

    # A column of its own: inside the lambda it would be computed for every run.
    marked = rows.withColumn("_starts", first_of_run)
    return marked.withColumn("blocks", F.transform(starts, run)).drop("_starts")


def _gathered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: the rows' blocks in order, merged where roles meet."""
    item = F.struct(*order, "blocks")
    sorted_blocks = F.transform(F.sort_array(F.collect_list(item)), lambda x: x.blocks)
    return _merged(rows.groupBy(*keys).agg(F.flatten(sorted_blocks).alias("blocks")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, segments`` from rows (conv_id, turn, role, text).

    ``segments`` is the loss mask: an array of (text, loss) whose texts together are
    ``formatted``; ``loss`` holds for the texts of ``loss_role``. Turns are ordered by
    turn, ties by role and text, null turns first. Null texts and roles count as empty,
    a null conv_id is a conversation of its own, repeated rows stay repeated, other
    columns are ignored, and no rows give none.

    Turns are gathered in segments of a conversation first and segments then joined, so
    that formatting a conversation that holds most rows is spread over tasks; only the
    final string, one row by contract, meets in one place.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment"),
        F.array(
            F.struct(
                F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(BREAK)).alias("role"),
                F.array(escaped(F.col("text"))).alias("texts"),
            )
        ).alias("blocks"),
    )
    parts = _gathered(rows, ["conv_id", "segment"], ["turn", "role", "text"])
    whole = _gathered(parts, ["conv_id"], ["segment"])
    segments = F.flatten(F.transform("blocks", _segments(loss_role))).alias("segments")
    return whole.select("conv_id", segments).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        "segments",
    )


def _segments(loss_role: str) -> Callable[[Column], Column]:
    def of(block: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        texts = F.transform(
            block.texts,
            lambda t, i: F.array(
                piece(F.when(i > 0, SEP).otherwise(""), no), piece(t, block.role == loss_role)
            ),
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(START), block.role, F.lit("\n")), no)),
            F.flatten(texts),
            F.array(piece(F.lit(END + "\n"), no)),
        )

    return of


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block))
        role = unescaped(F.replace(head, F.lit(BREAK), F.lit("\n")))
        texts = F.split(F.substring_index(body, END, 1), r"<\|im_sep\|>", -1)
        return F.transform(
            texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    under = F.filter(segments, lambda s: s.loss)
    return F.array_join(F.transform(under, lambda s: unescaped(s.text)), "")
