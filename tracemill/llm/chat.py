"""Chat formatting with collapse of cumulative snapshots.

A chat log often holds a conversation several times, each snapshot a few turns longer. Every
turn gets a rolling hash of its conversation up to and with it; a conversation whose last hash
and length occur inside a longer one is a snapshot of that and goes; of equal conversations the
smallest id stays. Both steps are anti-joins on (length, hash), whose sides are distinct first,
so a turn that opens a third of all conversations is one row. Then the rest is rendered.

The rolling hash is the exclusive-or of the turns' hashes, each mixed with its position, so it
can be computed in blocks of turns: offsets by block, then a window within the block. Two hashes
make 128 bits. The rendering is a row a turn, whatever a conversation's length, so no row grows
with it; `assembled` joins the turns of conversations that fit in a row.

Edge cases: turns repeated in full are one turn; turns of equal number are ordered by role, then
by their text's hash; null turn numbers order first, a null role is `unknown`, a null text is empty;
line breaks in a role are spaces, and marks in a role or text are broken; a null conversation id is
one conversation; a long text is one turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turn numbers that make a block of the rolling hash.
PART = 1024
START, END = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    """Turns with defaults for nulls and 128 bits of their texts' hashes."""
    text = F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(7), text).alias("g2"))


def positions(turns: DataFrame, part: int = PART) -> DataFrame:
    """Distinct turns with their texts' hashes, pos (from 0 in the conversation), and prefix hashes h1, h2 up to and with the turn. No texts."""
    rows = _turns(turns).drop("text").distinct().withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / part))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "g1", "g2")
    same = [rows["conv_id"].eqNullSafe(starts["conv_id"]), rows["block"] == starts["block"]]
    rows = rows.join(starts, same).select(rows["*"], "start").withColumn("pos", F.col("start") + F.row_number().over(order) - 1)
    rows = written(rows.withColumn("t1", F.xxhash64("pos", "role", "g1")).withColumn("t2", F.xxhash64(F.lit(7), "g2", "role", "pos")))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = sums.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("o1"), F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("o2"),
    )
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(before, [rows["conv_id"].eqNullSafe(before["_conv"]), rows["block"] == before["_block"]])
    return rows.select(
        "conv_id", "turn", "role", "g1", "g2", "pos",
        F.bit_xor("t1").over(upto).bitwiseXOR(F.col("o1")).alias("h1"), F.bit_xor("t2").over(upto).bitwiseXOR(F.col("o2")).alias("h2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and length of the conversations that no longer one begins with, one of each group of equals."""
    lengths = prefixes.groupBy("conv_id").agg(F.max("pos").alias("last"))
    last = lengths.withColumnRenamed("conv_id", "_conv")
    ends = prefixes.select("conv_id", "pos", "h1", "h2").join(last, prefixes["conv_id"].eqNullSafe(last["_conv"]))
    inner = ends.filter("pos < last").select("pos", "h1", "h2").distinct()
    whole = ends.filter("pos = last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", (F.col("pos") + 1).alias("n_turns"))


def _safe(value: Column) -> Column:
    """A value with its marks broken, so that they can't be taken for turns."""
    return F.replace(F.replace(value, F.lit(START), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def _turn(role: Column, text: Column) -> Column:
    """A rendered turn; neither a text nor a role, which is one line, can open another turn."""
    return F.concat(F.lit(START), _safe(F.regexp_replace(role, r"[\r\n]+", " ")), F.lit("\n"), _safe(text), F.lit(END), F.lit("\n"))


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """A row a turn of every maximal conversation: conv_id, n_turns, pos (from 0) and the turn's chat.

    The chat of a conversation is its turns' in order of pos (`assembled`). Positions are found
    without the texts, which only move to meet the turns that stay.
    """
    prefixes = written(positions(turns, part))
    kept = maximal(prefixes).withColumnRenamed("conv_id", "_conv")
    stay = prefixes.join(kept, prefixes["conv_id"].eqNullSafe(kept["_conv"])).select("_conv", F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "pos", "n_turns")
    texts = _turns(turns)
    same = texts["conv_id"].eqNullSafe(stay["_conv"]) & texts["turn"].eqNullSafe(stay["_turn"]) & (F.col("role") == F.col("_role")) & (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))
    met = texts.join(stay, same).select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.col("pos").cast("bigint").alias("pos"), _turn(F.col("role"), F.col("text")).alias("chat"))
    return met.dropDuplicates(["conv_id", "pos"])


def assembled(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns and the whole chat, a row a conversation. Each must fit in a row, so turns of a null id stay apart in `render`'s rows."""
    whole = rendered.filter(F.col("conv_id").isNotNull()).groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("pos", "chat"))).alias("p"))
    return whole.select("conv_id", "n_turns", F.array_join("p.chat", "").alias("chat"))
