"""Relational chat formatting: turns become one marked string, by Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role merge into one message (an array of texts under one header), and messages
are concatenated.  The template is::

    <|im_start|>ROLE \\n TEXT [<|im_sep|> TEXT ...] <|im_end|> \\n

Control strings inside texts are escaped reversibly: a backslash is doubled and
then ``<|`` becomes ``<\\|``, so that no escaped text holds ``<|``.  In roles
``%``, line feeds and ``<`` become ``%25``, ``%0A`` and ``%3C``.

The result also has ``segments``, the formatted string cut into runs, each with
its place in the loss mask; joined, they give the formatted string.

Defined results: a null text or role counts as empty; a null turn sorts first;
turns with equal numbers sort by role and text (binary order), repeated rows all
stay; rows with a null conv_id form one conversation; an empty table gives an
empty result; other columns are ignored.  A conversation is one output row, so
one conversation has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _each(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_ROLE = [("%", "%25"), ("\n", "%0A"), ("<", "%3C")]


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to (conv_id, formatted, segments).

    ``segments`` is array<struct<text, loss>>; ``loss`` marks the texts of
    ``trained_role``, without headers, separators and end marks.
    """
    sorted_turns = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a message starts: at a turn whose role differs from that of the turn before.
    starts = sorted_turns.select(
        "conv_id",
        F.col("turns"),
        F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[greatest(i - 2, 0)].role)").alias("starts"),
    )
    messages = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                F.get("turns", at - 1)["role"].alias("role"),
                F.transform(
                    F.slice("turns", at, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - at),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ).alias("messages"),
    )
    run = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = messages.select(
        "conv_id",
        F.flatten(
            F.transform(
                "messages",
                lambda m: F.concat(
                    F.array(run(F.concat(F.lit(START), _each(m["role"], _ROLE), F.lit("\n")), F.lit(False))),
                    F.flatten(
                        F.transform(
                            m["texts"],
                            lambda x, k: F.when(k == 0, F.array(run(x, m["role"] == trained_role))).otherwise(
                                F.array(run(F.lit(SEP), F.lit(False)), run(x, m["role"] == trained_role))
                            ),
                        )
                    ),
                    F.array(run(F.lit(END), F.lit(False))),
                ),
            )
        ).alias("segments"),
    )
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """A formatted string back to array<struct<role, text>>, one for each turn."""
    split = lambda text, by: F.split(text, f"\\Q{by}\\E", -1)

    def of(message: Column) -> Column:
        role = _each(F.substring_index(message, "\n", 1), [(b, a) for a, b in reversed(_ROLE)])
        body = F.substr(message, F.instr(message, "\n") + 1)
        texts = split(F.substring_index(body, END, 1), SEP)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    whole = split(formatted, START)
    return F.flatten(F.transform(F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0))), of))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings and their loss masks gets back, as digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("kept"))
    loss = F.array_join(F.transform("kept", lambda s: unescape(s["text"])), "")
    return read.select("conv_id", "turns", loss.alias("loss"), "formatted").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
