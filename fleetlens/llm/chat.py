"""Chat formatting: an example for every assistant turn, with all turns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a turn, and other control strings of common chat
# templates. None of them may stand unescaped in a text.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
_ANGLED = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>"
_SQUARE = r"/?INST\]"

# A backslash behind the first character breaks a control string. One that has
# backslashes there already gets one more, so that each step can be undone.
_BREAK = ((rf"<(\\*)({_ANGLED})", r"<\\$1$2"), (rf"\[(\\*)({_SQUARE})", r"[\\$1$2"))
_MEND = ((rf"<\\(\\*)({_ANGLED})", r"<$1$2"), (rf"\[\\(\\*)({_SQUARE})", r"[$1$2"))

TRAINED_ROLE = "assistant"


def _replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def escape(text: Column) -> Column:
    return _replaced(text, _BREAK)


def unescape(text: Column) -> Column:
    return _replaced(text, _MEND)


def _role_line(role: Column) -> Column:
    """A role on one line: ``%`` and line ends are written as their codes."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand_examples(conversations: DataFrame) -> DataFrame:
    """One example per assistant turn: the turns before it, then the reply to learn.

    Returns conv_id, upto (turns in the example), complete (it holds all turns), text,
    loss_start and loss_end: the span of the reply in code points, end exclusive. Turns
    behind the last reply are kept in a last example, which has an empty span.

    Turns go by turn number; equal numbers by role, then text. A null role or text is
    an empty one. A conversation's turns meet in one row, since its longest example
    holds them all; shorter ones are cut from that row, one output row at a time.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = escape(text)
    segment = F.concat(
        F.lit(TURN_START), _role_line(role), F.lit("\n"), body, F.lit(TURN_END + "\n")
    )
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            segment.alias("segment"),
            F.char_length(body).alias("n_body"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ends = F.expr(
        f"filter(sequence(1, size(ts)), i -> i = size(ts) OR ts[i - 1].role = '{TRAINED_ROLE}')"
    )
    cut = whole.select(
        "conv_id",
        F.expr("transform(ts, t -> t.segment)").alias("segments"),
        F.expr(f"transform(ts, t -> IF(t.role = '{TRAINED_ROLE}', t.n_body, 0))").alias("n_body"),
        ends.alias("ends"),
    ).select("conv_id", "segments", "n_body", F.explode("ends").alias("upto"))
    joined = cut.select(
        "conv_id",
        F.col("upto").cast("int").alias("upto"),
        F.expr("upto = size(segments)").alias("complete"),
        F.array_join(F.slice("segments", F.lit(1), F.col("upto")), "").alias("text"),
        F.expr("n_body[upto - 1]").alias("n_loss"),
    )
    loss_end = F.char_length("text") - len(TURN_END + "\n")
    return joined.select(
        "conv_id",
        "upto",
        "complete",
        "text",
        (loss_end - F.col("n_loss")).alias("loss_start"),
        loss_end.alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""

    def turn(segment: Column) -> Column:
        line = F.substring_index(segment, "\n", 1)
        start = F.char_length(line) + 2
        n = F.char_length(segment) - F.char_length(line) - 1 - len(TURN_END + "\n")
        body = segment.substr(start, n)
        return F.struct(_role(line).alias("role"), unescape(body).alias("text"))

    segments = F.filter(F.split(text, r"<\|im_start\|>"), lambda s: s != "")
    return F.transform(segments, turn)


def read_reply(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """The text under the loss mask of an example."""
    return unescape(text.substr(loss_start + 1, loss_end - loss_start))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from their texts."""
    said = F.transform(
        read_turns(F.col("text")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
    )
    read = examples.select(
        "conv_id",
        "upto",
        F.when(F.col("complete"), said).alias("said"),
        read_reply(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
        F.char_length("text").cast("bigint").alias("n_chars"),
    ).select(
        "conv_id",
        "upto",
        F.when(F.col("said").isNotNull(), F.size("said").cast("bigint")).alias("n_turns"),
        F.sha2(F.array_join("said", ""), 256).alias("turns_sha256"),
        "reply",
        "n_chars",
    )
    replies = F.sort_array(F.collect_list(F.struct("upto", "reply")))
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_join(F.transform(replies, lambda r: r["reply"]), "").alias("loss"),
            F.sum("n_chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
