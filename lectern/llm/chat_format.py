"""Conversations as one text each, with the stretches a model is trained on, and back again.

Turns are sorted, neighbours of the same role become one block, and a block reads

    <|im_start|>role NEWLINE text <|im_next|> text ... <|im_end|> NEWLINE

with no blanks but those of the texts.  In texts and roles a backslash goes into every
``<|``, also behind backslashes that stand there already (``<|`` becomes ``<\\|`` and ``<\\|``
becomes ``<\\\\|``), so no text can hold a control string and every text can be read back.
A newline in a role is written as a control string of its own.

The loss mask has one entry per turn: code points of control text before it, code points
of the turn's text as written, and whether it bears loss.

Everything is a Spark expression, linear in the conversation; texts are shuffled once.  A
conversation is one value of the result, so Spark's 2 GB of one value bound its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

START, NEXT, END, LINE = "<|im_start|>", "<|im_next|>", "<|im_end|>", "<|im_line|>"
CLOSE = END + "\n"
LOSS_ROLES = ("assistant",)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))


def _runs(turns: Column) -> Column:
    """Neighbours of the same role, as an array of arrays of turns."""

    def cut(starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            # Not slice(), which copies all turns for every run.
            return F.transform(F.sequence(start, end - 1), lambda i: F.get(turns, i))

        return F.transform(starts, run)

    places = F.sequence(F.lit(0), F.size(turns) - 1)
    first = lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    return _let(F.filter(places, first), cut)


def _block(run: Column) -> Column:
    return F.struct(
        F.get(run, F.lit(0))["role"].alias("role"),
        F.transform(run, lambda turn: escaped(turn["text"])).alias("texts"),
    )


def _written(block: Column) -> Column:
    return F.concat(_header(block["role"]), F.array_join(block["texts"], NEXT), F.lit(CLOSE))


def _mask(blocks: Column, loss_roles: Sequence[str]) -> Column:
    def entries(block: Column, k: Column) -> Column:
        opening = F.char_length(_header(block["role"])) + F.when(k > 0, len(CLOSE)).otherwise(0)
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, opening).otherwise(len(NEXT)).cast("bigint").alias("skip"),
                F.char_length(text).cast("bigint").alias("chars"),
                block["role"].isin(*loss_roles).alias("loss"),
            ),
        )

    return F.flatten(F.transform(blocks, entries))


def format_conversations(rows: DataFrame, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; other columns are left out).

    Rows go by turn, then role, then text, nulls of ``turn`` first.  A null role or text is
    empty; rows without id form one conversation; rows that repeat are turns of their own.
    Returns conv_id, formatted, loss_mask (skip, chars, loss per turn); no rows give none.
    """
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # The one-element explode keeps the optimizer from repeating what stands in it.
    blocks = sorted_turns.select("conv_id", F.explode(F.array(F.transform(_runs(F.col("turns")), _block))).alias("blocks"))
    return blocks.select(
        "conv_id",
        _joined(F.transform("blocks", _written)).alias("formatted"),
        _mask(F.col("blocks"), loss_roles).alias("loss_mask"),
    )


def _turns_of(block: Column) -> Column:
    def texts(role: Column) -> Column:
        at = F.char_length(role) + 2
        body = F.substr(block, at, F.char_length(block) - at - len(CLOSE) + 1)
        name = unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))
        return _let(
            name,
            lambda own: F.transform(
                F.split(body, r"<\|im_next\|>", -1), lambda text: F.struct(own.alias("role"), text.alias("written"))
            ),
        )

    return _let(F.substring_index(block, "\n", 1), texts)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and the text as written (see :func:`unescaped`)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    return F.flatten(F.transform(blocks, _turns_of))


def masked_text(turns: Column, mask: Column) -> Column:
    """All text under the mask, unescaped; fails where the mask does not fit the turns."""

    def under(turn: Column, entry: Column) -> Column:
        fits = F.char_length(turn["written"]).cast("bigint") == entry["chars"]
        wrong = F.raise_error(F.lit("the loss mask does not fit the text")).cast("string")
        return F.when(~F.coalesce(fits, F.lit(False)), wrong).when(entry["loss"], unescaped(turn["written"]))

    return _joined(F.zip_with(turns, mask, under))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: counts and digests of its turns and of the text under its mask."""
    parsed = formatted.select(
        "conv_id",
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.explode(F.array(F.struct(read_turns(F.col("formatted")).alias("turns"), F.col("loss_mask").alias("mask")))).alias("got"),
    )
    line = lambda turn: F.concat(turn["role"], F.lit("\n"), unescaped(turn["written"]), F.lit("\n"))
    said = parsed.select(
        "conv_id",
        "formatted_chars",
        F.size("got.turns").cast("bigint").alias("n_turns"),
        F.sha2(_joined(F.transform("got.turns", line)).cast("binary"), 256).alias("turns_sha256"),
        F.explode(F.array(masked_text(F.col("got.turns"), F.col("got.mask")))).alias("loss_text"),
    )
    return said.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
