"""Chat formatting with Spark expressions only.

Template: each run of adjacent turns of one role is ``<|turn|>role<|text|>text<|more|>text<|end|>``,
so a merged block still tells its turns apart. Inside roles and texts one backslash goes after the
first character of anything that reads as a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``, with any number of backslashes already there); taking one away again restores the text.

The loss mask is a list of spans (start, length in code points), one for each assistant text.

Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one defined
order and each stays a turn of its own. A null role or text is empty; rows with a null conv_id form
one conversation. Turns are collected in blocks of ``BLOCK_TURNS`` first and the finished blocks
are joined afterwards, so a very long conversation is sorted and formatted by many tasks; only its
one output string is made in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
LEARNED_ROLE = "assistant"
BLOCK_TURNS = 256

_CONTROL = r"(\||/?s>|/?INST\])"
_SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    turns = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    blocks = (
        turns.groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", "block", _pieces(F.col("turns")).alias("pieces"))
        .select("conv_id", F.struct("block", *_block()).alias("part"))
    )
    return (
        blocks.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("conv_id", _with_heads(F.col("parts")).alias("parts"))
        .select(
            "conv_id",
            F.concat(
                F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), ""),
                F.lit(END),
            ).alias("formatted"),
            _joined_spans(F.col("parts")).alias("loss_spans"),
        )
    )


def _open(role: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT))


def _head(at: Column, earlier_role: Column, role: Column) -> Column:
    """What goes before a text: nothing is closed before the first, equal roles merge."""
    return (
        F.when(at == 0, _open(role))
        .when(earlier_role == role, F.lit(MORE))
        .otherwise(F.concat(F.lit(END), _open(role)))
    )


def _before(items: Column, at: Column) -> Column:
    return F.get(items, at - 1)


def _pieces(turns: Column) -> Column:
    """Turns as (role, head, text); the first head of a block is left to the joining step."""
    return F.transform(
        turns,
        lambda t, at: F.struct(
            t["role"].alias("role"),
            F.when(at == 0, F.lit(""))
            .otherwise(_head(at, _before(turns, at)["role"], t["role"]))
            .alias("head"),
            escape(t["text"]).alias("text"),
        ),
    )


def _block() -> list[Column]:
    pieces = F.col("pieces")
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans")
    )

    def add(done: Column, piece: Column) -> Column:
        text_at = done["at"] + F.length(piece["head"])
        span = F.struct(text_at.alias("start"), F.length(piece["text"]).cast("bigint").alias("length"))
        return F.struct(
            (text_at + F.length(piece["text"])).alias("at"),
            F.when(piece["role"] == LEARNED_ROLE, F.concat(done["spans"], F.array(span)))
            .otherwise(done["spans"])
            .alias("spans"),
        )

    return [
        F.element_at(pieces, 1)["role"].alias("first_role"),
        F.element_at(pieces, -1)["role"].alias("last_role"),
        F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"])), "").alias("body"),
        F.aggregate(pieces, start, add)["spans"].alias("spans"),
    ]


def _with_heads(parts: Column) -> Column:
    return F.transform(
        parts,
        lambda p, at: F.struct(
            _head(at, _before(parts, at)["last_role"], p["first_role"]).alias("head"),
            p["body"].alias("body"),
            p["spans"].alias("spans"),
        ),
    )


def _joined_spans(parts: Column) -> Column:
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans")
    )

    def add(done: Column, part: Column) -> Column:
        body_at = done["at"] + F.length(part["head"])
        moved = F.transform(
            part["spans"],
            lambda s: F.struct((s["start"] + body_at).alias("start"), s["length"].alias("length")),
        )
        return F.struct(
            (body_at + F.length(part["body"])).alias("at"),
            F.concat(done["spans"], moved).alias("spans"),
        )

    return F.aggregate(parts, start, add)["spans"]


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before."""
    blocks = F.filter(F.split(formatted, _literal(TURN)), lambda b: b != "")

    def turns(block: Column) -> Column:
        # Texts hold no control string, so the first TEXT and the last END are the template's.
        both = F.split(block, _literal(TEXT), 2)
        texts = F.split(F.regexp_replace(both[1], _literal(END) + "$", ""), _literal(MORE), -1)
        return F.transform(
            texts,
            lambda t: F.struct(unescape(both[0]).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    # Four bytes for each code point: a span is then cut out without walking the string.
    wide = F.encode(formatted, "UTF-32")
    return F.transform(
        spans,
        lambda s: unescape(
            F.decode(
                F.substring(
                    wide, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")
                ),
                "UTF-32",
            )
        ),
    )


def _literal(marker: str) -> str:
    return marker.replace("|", r"\|")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What reads back from ``format_chats``: counts and digests of turns and learned texts."""
    lined = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return (
        formatted.select(
            "conv_id",
            "formatted",
            read_turns(F.col("formatted")).alias("turns"),
            F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        )
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(lined, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
