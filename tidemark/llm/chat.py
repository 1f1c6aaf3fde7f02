"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all turns before it as context and only that reply
under the loss mask. A conversation that does not end with an assistant turn has one more example, the
whole conversation with an empty mask, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import blank, packed

# Control strings of public chat templates.
HEAD, BODY, END = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
CONTROL = r"(<)(\|)|(<)(/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)"

TARGET = "assistant"


def escape(text: Column) -> Column:
    """No control string is left: backslashes are doubled, and one is put after a control string's first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$3$5$7\\$2$4$6$8")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role), F.lit(BODY), escape(text), F.lit(END))


def format_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example (from 0), n_turns, has_target, formatted, loss_start, loss_end.

    The mask covers the characters loss_start to loss_end (from 0, end exclusive) of `formatted`: the reply
    without its closing mark. Turns go by `turn` (nulls first), ties by role and text; null roles and texts count
    as empty, null conversation ids are one conversation, an empty table gives no rows. A turn that repeats
    is a turn of its own.

    A conversation is one row here, as an example holds its whole context anyway: the turns are folded
    once, and each example is a prefix of that one formatted string, so nothing is joined.
    """
    rows = packed(turns, conv, turn, role, text)
    by_conv = rows.groupBy(F.col(f"`{conv}`").alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(f"`{turn}`").alias("turn"), blank(F.col(f"`{role}`")).alias("role"), blank(F.col(f"`{text}`")).alias("text")))).alias("turns")
    )
    # Per turn its piece, the characters up to its end and those of the reply with its mark.
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            formatted_turn(t["role"], t["text"]).alias("piece"),
            F.length(formatted_turn(t["role"], t["text"])).cast("long").alias("chars"),
            F.length(escape(t["text"])).cast("long").alias("reply"),
            (t["role"] == TARGET).alias("target"),
        ),
    )
    folded = by_conv.select("conv", pieces.alias("pieces")).select(
        "conv",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("whole"),
        F.size("pieces").alias("turns"),
        F.aggregate(
            "pieces",
            F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<stop:bigint,reply:bigint,n:int>>").alias("found")),
            lambda s, p: F.struct(
                (s["at"] + p["chars"]).alias("at"),
                (s["n"] + 1).alias("n"),
                F.when(p["target"], F.concat(s["found"], F.array(F.struct((s["at"] + p["chars"]).alias("stop"), p["reply"].alias("reply"), (s["n"] + 1).alias("n"))))).otherwise(s["found"]).alias("found"),
            ),
            lambda s: s["found"],
        ).alias("found"),
    )
    closing = F.struct(F.length("whole").cast("long").alias("stop"), F.lit(None).cast("long").alias("reply"), F.col("turns").alias("n"))
    open_end = F.when(F.size("found") == 0, F.lit(True)).otherwise(F.try_element_at("found", F.lit(-1))["n"] < F.col("turns"))
    examples = folded.select("conv", "whole", F.posexplode(F.when(open_end, F.concat("found", F.array(closing))).otherwise(F.col("found"))).alias("example", "e"))
    stop = F.col("e.stop") - F.length(F.lit(END))
    has = F.col("e.reply").isNotNull()
    return examples.select(
        F.col("conv").alias(conv),
        "example",
        F.col("e.n").alias("n_turns"),
        has.alias("has_target"),
        F.substring("whole", F.lit(1), F.col("e.stop").cast("int")).alias("formatted"),
        F.when(has, stop - F.col("e.reply")).otherwise(F.col("e.stop")).alias("loss_start"),
        F.when(has, stop).otherwise(F.col("e.stop")).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted example as an array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(len(HEAD) + 1), F.length(p)), BODY, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit(BODY)) + len(BODY), F.length(p))).alias("text"),
        ),
    )


def masked(formatted: Column, start: Column, end: Column) -> Column:
    """Unescaped text under the loss mask."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def conversation_digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back per conversation: its turns from the longest example, its replies from all masks.

    n_turns, turns_sha256, loss_chars, loss_sha256, and formatted_chars (characters of all its examples).
    """
    read = examples.select(
        F.col(conv),
        "example",
        F.length("formatted").cast("long").alias("chars"),
        "formatted",
        F.when(F.col("has_target"), masked(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("reply"),
    )
    per = read.groupBy(conv).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda r: r["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = read_back(F.col("longest"))
    return per.select(conv, said.alias("said"), "loss", "formatted_chars").select(
        conv,
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
