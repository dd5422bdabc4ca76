"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often hold a conversation several times, each time with a few more turns. A turn's hash covers its place,
role and text; the exclusive-or of a conversation's first k turn hashes is its rolling prefix hash (two of 64 bits
each). A conversation whose hash over all its turns is the hash of a shorter prefix of another one is a snapshot of
that one; anti-joins against the distinct proper-prefix hashes keep the maximal conversations, and of equal ones the
one with the smallest conv_id. Those are rendered, one segment for each turn with its place in the whole.

Only ids and hashes go through the windows; texts are shuffled once, in the join with the turns that stay. A
conversation is cut into chunks of turn numbers, and places, hashes and offsets are summed within chunks and then over
chunks, so one huge conversation is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import stash

CHUNK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    """One turn between markers; markers that the text or role itself holds are broken by a space."""
    plain = lambda x: F.replace(x, F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(f"{CLOSE}\n"))


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equality of keys that takes null for a value."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    other = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2, k (place from 0), start (offset of the segment), p1, p2 (hashes of turns 0 to k).

    `turns` has conv_id, turn, h1, h2, chars, no row twice.
    """
    chunked = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1)))
    group = ("conv_id", "chunk")
    sizes = chunked.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*group).orderBy("turn", "h1", "h2")
    placed = _joined(chunked, bases, group).withColumn("k", F.col("base") + F.row_number().over(within) - 1).drop("base")
    placed = placed.withColumn("g1", F.xxhash64("k", "h1", "h2")).withColumn("g2", F.xxhash64("h2", "h1", "k", F.lit(2)))
    placed, _ = stash(placed, "chat-turns")
    sums = placed.groupBy(*group).agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"), F.sum("chars").alias("s3"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    earlier = sums.select(*group, zero(F.bit_xor("s1").over(before)).alias("b1"), zero(F.bit_xor("s2").over(before)).alias("b2"), zero(F.sum("s3").over(before)).alias("b3"))
    upto = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = _joined(placed, earlier, group)
    return rolled.select(
        "conv_id", "turn", "h1", "h2", "k",
        (F.col("b3") + F.sum("chars").over(upto) - F.col("chars")).alias("start"),
        F.col("b1").bitwiseXOR(F.bit_xor("g1").over(upto)).alias("p1"),
        F.col("b2").bitwiseXOR(F.bit_xor("g2").over(upto)).alias("p2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: conversations that aren't a proper prefix of another; one of equal ones."""
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("p1", "p2"), "k").alias("p"), (F.max("k") + 1).alias("n_turns"))
    whole = whole.select("conv_id", "n_turns", "p.p1", "p.p2")
    key = ("n_turns", "p1", "p2")
    classes = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    part = _joined(prefixes.select("conv_id", "k", "p1", "p2"), whole.select("conv_id", F.col("n_turns").alias("of")), ("conv_id",))
    proper = part.where(F.col("k") + 1 < F.col("of")).select((F.col("k") + 1).alias("n_turns"), "p1", "p2").distinct()
    return classes.join(proper, list(key), "left_anti").select("conv_id", "n_turns", "copies")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_index, role, rendered, start, n_turns, copies: the turns of maximal conversations, rendered.

    `conversations` has conv_id, turn, role, text. Turns follow by turn number (null first), equal numbers by hash; rows
    repeated in all four columns count once. A null role is `user`, a null text is empty. Rows with a null conv_id make
    one conversation together. `start` is the segment's first character in the concatenation of the conversation's
    segments, `copies` the number of equal conversations. Empty tables give an empty result; other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", "role", F.lit(2)))
    rows = rows.withColumn("rendered", render_turn(F.col("role"), F.col("text")))
    id_ = ("conv_id", "turn", "h1", "h2")
    turns = rows.select(*id_, F.char_length("rendered").cast("bigint").alias("chars")).distinct()
    prefixes, _ = stash(prefix_hashes(turns), "chat-prefixes")
    stay = _joined(prefixes.drop("p1", "p2"), maximal(prefixes), ("conv_id",))
    told = _joined(rows.select(*id_, "role", "rendered"), stay, id_).dropDuplicates([*id_])
    return told.select("conv_id", F.col("k").cast("int").alias("turn_index"), "role", "rendered", "start", F.col("n_turns").cast("int").alias("n_turns"), "copies")
