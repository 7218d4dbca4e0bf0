"""Connected components by label contraction, in the DataFrame API.

Nodes are longs that behave like random numbers (hashes or fingerprints).
Each round every label moves to the smallest label next to it, chains of
moves are shortened by joining the moves with themselves, and links are
rewritten to labels and deduplicated; links inside one label vanish. As
labels are random, chains are short and the links shrink geometrically.
Every round is written to the shared workspace, which cuts the lineage,
and the tables of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import discard, written


def components(links: DataFrame, jumps: int = 2) -> DataFrame:
    """``links(a long, b long)`` to ``(node, root)``, root the smallest node reached.

    Nulls and self links are ignored; repeated links count once. Nodes
    without links do not appear. An empty input gives an empty result.
    """
    links = written(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not links.isEmpty():
        # b is the larger end, so only b can move; the smallest neighbour of each b is its move
        move = links.groupBy(F.col("b").alias("at")).agg(F.min("a").alias("to"))
        step = move = written(move, "moves")
        for _ in range(jumps):
            onward = move.select(F.col("at").alias("to"), F.col("to").alias("further"))
            move = move.join(onward, "to", "left").select("at", F.coalesce("further", "to").alias("to"))
        move = written(move, "moves")
        last_labels, last_links = labels, links
        labels = written(
            labels.join(move, labels.root == move["at"], "left").select("node", F.coalesce("to", "root").alias("root")),
            "labels",
        )
        ma = move.select(F.col("at").alias("a"), F.col("to").alias("a2"))
        mb = move.select(F.col("at").alias("b"), F.col("to").alias("b2"))
        links = written(
            links.join(mb, "b", "left")
            .join(ma, "a", "left")
            .select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
        discard(step, move, last_labels, last_links)
    return labels
