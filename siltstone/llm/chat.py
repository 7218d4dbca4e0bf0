"""Chat formatting: cumulative snapshots are collapsed, then conversations rendered, in DataFrame operations alone.

Logs often hold a conversation again after every turn. A rolling hash of
each turn prefix identifies conversations that are a prefix of a longer
one: hashes of (place, role, text) are combined by exclusive or, so a
prefix hash is a running aggregate, and long conversations are handled in
chunks whose hashes combine the same way. Equal conversations are merged
first; an anti-join with the distinct proper prefixes leaves the maximal
ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import written

#: Turn numbers of a chunk, and turns of a rendered part.
CHUNK = 256


def placed(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, ..)`` with ``pos``, its place in the conversation from 1.

    Order is by turn (nulls first), then by role and text. A chunk of
    turn numbers is ordered by one task, and the chunks' counts are added
    up, so that no conversation needs one task for all its turns.
    """
    rows = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    counts = rows.groupBy("conv_id", "chunk").count()
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    return rows.withColumn("pos", F.row_number().over(inside)).join(counts, ["conv_id", "chunk"]).withColumn("pos", F.col("pos") + F.col("base")).drop("base", "chunk")


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, pos, role, text)`` to ``(conv_id, pos, n, h1, h2)``: the hash of every turn prefix, n turns in all."""
    a, b = F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "text", "role")
    rows = rows.select("conv_id", "pos", F.xxhash64("pos", a).alias("a"), F.xxhash64(b, "pos").alias("b"), F.floor((F.col("pos") - 1) / CHUNK).alias("part"))
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"), F.count("*").alias("k"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sums = sums.select(
        "conv_id",
        "part",
        F.coalesce(F.bit_xor("a0").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b0").over(before), F.lit(0)).alias("b0"),
        F.sum("k").over(whole).alias("n"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.withColumn("h1", F.bit_xor("a").over(inside)).withColumn("h2", F.bit_xor("b").over(inside)).join(sums, ["conv_id", "part"])
    return rolled.select("conv_id", "pos", "n", F.col("h1").bitwiseXOR(F.col("a0")).alias("h1"), F.col("h2").bitwiseXOR(F.col("b0")).alias("h2"))


def cleaned(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text).distinct()


def maximal(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, pos, role, text)`` to ``(conv_id, turns, copies)``: conversations that are no prefix of a longer one; of equal ones the smallest id, and how many there are."""
    rolled = written(prefixes(rows), "prefixes")
    ends = rolled.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = rolled.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return ends.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to (conv_id, part, turns, copies, rendered): the maximal conversations.

    A turn becomes ``<|role|>``, its text and ``<|end|>`` on lines; the
    two marks that open and close these are broken up inside texts. Every
    256 turns make a part, from 0. Null roles and texts count as empty,
    equal rows as one; turns that share a number follow in the order of
    role and text; rows without a conv_id belong to none and go. An empty
    table gives no rows; other columns are not read.
    """
    rows = written(placed(cleaned(turns)), "turns")
    kept = written(maximal(rows), "maximal")
    rows = rows.join(kept.select("conv_id"), "conv_id", "left_semi")
    guarded = [F.regexp_replace(F.regexp_replace(F.col(c), r"<\|", "< |"), r"\|>", "| >") for c in ("role", "text")]
    line = F.concat(F.lit("<|"), guarded[0], F.lit("|>\n"), guarded[1], F.lit("\n<|end|>\n"))
    parts = rows.select("conv_id", F.floor((F.col("pos") - 1) / CHUNK).alias("part"), "pos", line.alias("line"))
    parts = parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return parts.select("conv_id", "part", text.alias("rendered")).join(kept, "conv_id").select("conv_id", "part", "turns", "copies", "rendered")
