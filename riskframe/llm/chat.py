"""Chat formatting with collapse of cumulative snapshots.

A chat log often holds the same conversation many times, each one turn longer.
Every turn gets a position-salted 128-bit hash; their running XOR names each
prefix of each conversation. A conversation whose full name equals a proper
prefix of another one is dropped by an anti-join on (length, name); equal
conversations collapse to the smallest id. What stays is rendered.

Ranks and running hashes are two-level (block of turn numbers, then inside the
block), so a conversation with a third of all turns is spread over many tasks,
and rendering cuts conversations into parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("__ci"), F.col("__cr").isNull(), F.coalesce("__cr", F.lit("")),
                      F.col("__ct").isNull(), F.coalesce("__ct", F.lit("")))


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", block_turns: int = 1024) -> DataFrame:
    """(__cc conversation, __ci 1-based position, __cr role, __ct text, __h1, __h2 hash of the prefix up to here).

    Turns are ordered by (turn, role, text), NULLs first; rows without a conversation id are not chat and are left out.
    """
    t = turns.select(F.col(conv_col).alias("__cc"), F.col(turn_col).alias("__cn"), F.col(role_col).alias("__cr"),
                     F.col(text_col).alias("__ct")).filter(F.col("__cc").isNotNull())
    t = t.withColumn("__cb", F.coalesce(F.floor(F.col("__cn") / block_turns), F.lit(-(2**62))))
    inside = Window.partitionBy("__cc", "__cb").orderBy("__cn", "__cr", "__ct")
    earlier = Window.partitionBy("__cc").orderBy("__cb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("__cc", "__cb").agg(F.count(F.lit(1)).alias("__cs")).select(
        "__cc", "__cb", F.coalesce(F.sum("__cs").over(earlier), F.lit(0)).alias("__co"))
    t = t.withColumn("__cp", F.row_number().over(inside)).join(sizes, ["__cc", "__cb"])
    t = t.withColumn("__ci", F.col("__co") + F.col("__cp"))
    t = t.withColumns({"__a1": _turn_hash(1), "__a2": _turn_hash(2)})
    blocks = t.groupBy("__cc", "__cb").agg(F.bit_xor("__a1").alias("__b1"), F.bit_xor("__a2").alias("__b2")).select(
        "__cc", "__cb", *[F.coalesce(F.bit_xor(f"__b{i}").over(earlier), F.lit(0).cast("long")).alias(f"__o{i}") for i in (1, 2)])
    run = Window.partitionBy("__cc", "__cb").orderBy("__ci").rowsBetween(Window.unboundedPreceding, 0)
    return t.join(blocks, ["__cc", "__cb"]).select(
        "__cc", "__ci", "__cr", "__ct",
        *[F.col(f"__o{i}").bitwiseXOR(F.bit_xor(f"__a{i}").over(run)).alias(f"__h{i}") for i in (1, 2)])


def maximal_conversations(named: DataFrame) -> DataFrame:
    """(__cc, __cl turns, __cx equal copies) of the conversations that no longer one continues."""
    lengths = named.groupBy("__cc").agg(F.max("__ci").alias("__cl"))
    ends = named.select("__cc", "__ci", "__h1", "__h2").join(lengths, "__cc").withColumn("__cend", F.col("__ci") == F.col("__cl"))
    full = ends.filter("__cend").groupBy("__cl", "__h1", "__h2").agg(
        F.min("__cc").alias("__cc"), F.count(F.lit(1)).alias("__cx"))
    prefixes = ends.filter(~F.col("__cend")).select(F.col("__ci").alias("__cl"), "__h1", "__h2").distinct()
    return full.join(prefixes, ["__cl", "__h1", "__h2"], "left_anti").select("__cc", "__cl", "__cx")


def _safe(text: Column, marks: tuple[str, ...]) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(m[0] + " " + m[1:]))
    return text


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", start: str = "<|im_start|>", end: str = "<|im_end|>",
                 part_turns: int = 512) -> DataFrame:
    """One row per retained conversation and part: conv_id, part, n_parts, n_turns, n_copies, rendered.

    A turn is written ``start role newline text end newline``; the two marks inside a role or text are
    broken by a blank, so that no text can open or close a turn. Joining a conversation's parts in
    order gives its whole text; a conversation of at most ``part_turns`` turns has one part.

    * NULL role is written ``unknown``, NULL text as empty; both differ from real values when compared.
    * Turns that tie on their number are ordered by role, then text; repeated rows are turns of their own.
    * Rows without a conversation id are left out; an empty table gives no rows; other columns are ignored.
    """
    named = prefix_hashes(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal_conversations(named)
    marks = (start, end)
    line = F.concat(F.lit(start), _safe(F.coalesce("__cr", F.lit("unknown")), marks), F.lit("\n"),
                    _safe(F.coalesce("__ct", F.lit("")), marks), F.lit(end + "\n"))
    rows = named.select("__cc", "__ci", line.alias("__line")).join(kept, "__cc")
    rows = rows.withColumn("part", F.floor((F.col("__ci") - 1) / part_turns).cast("int"))
    out = rows.groupBy("__cc", "part").agg(
        F.max("__cl").alias("n_turns"), F.max("__cx").alias("n_copies"),
        F.array_sort(F.collect_list(F.struct("__ci", "__line"))).alias("__lines"))
    return out.select(
        F.col("__cc").alias(conv_col), "part", F.ceil(F.col("n_turns") / part_turns).cast("int").alias("n_parts"),
        "n_turns", "n_copies", F.array_join(F.col("__lines.__line"), "").alias("rendered"))
