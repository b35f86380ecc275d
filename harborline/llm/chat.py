"""Chat formatting: cumulative snapshots collapse to maximal conversations, then render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.sources.durable import stored

CHUNK = 1024  # turn numbers that one window orders
PART = 64  # turn numbers that are rendered into one row
LANES = 4
FIRST = -(1 << 62)  # where a null turn stands
SUMS = [f"s{i}" for i in range(LANES)]
KEY = ["n", *SUMS]


def _turn_lanes(role: Column, text: Column) -> list[Column]:
    """Four 32-bit hashes of a turn; their sums over turns tell sets of turns apart."""
    parts = [F.col("pos"), role.isNull(), role, text.isNull(), text]
    lanes = []
    for salt in range(LANES // 2):
        h = F.xxhash64(F.lit(salt), *parts)
        lanes += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [lane.alias(s) for lane, s in zip(lanes, SUMS)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, pos, n, s0..s3)``: the rolling hash of every conversation up to every turn.

    Turn hashes include the turn's number, so a prefix's hash is a sum. Sums of blocks of
    turn numbers are added up first and turns inside their block only: a conversation with
    a third of all turns is no single window.
    """
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    block = turns.select("conv", chunk, *KEY)
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = block.groupBy("conv", "chunk").agg(*[F.sum(c).alias(c) for c in KEY])
    before = sums.select(
        F.col("conv").alias("_conv"),
        F.col("chunk").alias("_chunk"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in KEY],
    )
    inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv", "pos", chunk, *[c for c in KEY]).select(
        "conv", "pos", "chunk", *[F.sum(c).over(inside).alias(c) for c in KEY]
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    return running.join(before, same).select(
        "conv", "pos", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in KEY]
    )


def maximal_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, copies)``: conversations that are no proper prefix of a longer one.

    A snapshot whose turns are the first turns of another conversation goes. Of equal
    conversations the smallest id stays; ``copies`` counts them. Prefix hashes are made
    distinct before they are joined, so a first turn shared by a third of all
    conversations is one row of the join.
    """
    read = turns.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("pos"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    hashed = read.select("conv", "pos", *_turn_lanes(F.col("role"), F.col("text"))).distinct()
    per_turn = stored(
        hashed.groupBy("conv", "pos").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    )
    prefixes = stored(_prefixes(per_turn))
    whole = prefixes.groupBy("conv").agg(F.max(F.struct("n", *SUMS)).alias("w")).select("conv", "w.*")
    whole = stored(whole)
    ends = whole.select(F.col("conv").alias("_conv"), F.col("n").alias("_n"))
    proper = prefixes.join(
        ends, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("n") < F.col("_n"))
    ).select(*KEY)
    chosen = whole.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    return chosen.join(proper.distinct(), KEY, "left_anti").select("conv", "copies")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, part, copies, n_turns, trained_chars, text``: maximal conversations, rendered.

    Turns are rendered in order of their numbers, each as ``<|role|>``, text and ``<|end|>``.
    A row holds up to 64 turn numbers; a longer conversation has several rows, ``part``
    counting them from 0, whose texts follow each other. ``trained_chars`` counts the code
    points of assistant turns, those a model is trained on.

    Turn numbers are part of a turn: snapshots count from the same number. A null turn
    stands before all others, in part 0 too; a null role is rendered as ``unknown``, a null
    text as empty. Turns with one number are ordered by role and text; equal rows count
    once. A null conversation id is one conversation. An empty table gives no rows. Further
    columns of the input are not read.
    """
    kept = stored(maximal_conversations(turns, conv, turn, role, text)).select(
        F.col("conv").alias("_conv"), "copies"
    )
    read = turns.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("pos"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    of = F.col("conv_id").eqNullSafe(F.col("_conv"))
    part = F.greatest(F.floor(F.col("pos") / PART), F.lit(0))
    whole = F.array_distinct(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))))
    trained = F.filter("turns", lambda t: t["role"] == "assistant")
    rows = (
        read.join(kept, of)
        .groupBy("conv_id", part.alias("part"))
        .agg(F.first("copies").alias("copies"), whole.alias("turns"))
    )
    return rows.select(
        "conv_id",
        "part",
        "copies",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(trained, F.lit(0), lambda acc, t: acc + F.length(t["text"])).cast("long").alias("trained_chars"),
        F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("text"),
    )
