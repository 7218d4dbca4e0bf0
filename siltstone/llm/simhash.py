"""SimHash near-dedup by pigeonhole blocks.

A 64-bit fingerprint is cut into more blocks than bits may differ, so two
close fingerprints agree on several whole blocks. Every choice of blocks
is a key; equal fingerprints are merged first, distinct ones meet on a key
and are verified by Hamming distance. Keys shared by many fingerprints
are cut into cells of a bounded number of rows, each pair of chunks of
the key in one cell, so no task gets a whole hot key; a cell returns only
a spanning forest of its links. Components come from label contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ready, spread
from siltstone.llm.components import components
from siltstone.session import written

SEED = 42
#: Distinct fingerprints up to which 5 blocks, 2 a key (10 keys of 25 bits) are used; beyond, 6 blocks, 3 a key (20 keys of 31 bits).
FEW = 1 << 24
#: Rows of a cell: a chunk has at least this many, a 64th of its key's rows, or at most CELL_MOST.
CELL_LEAST, CELL_MOST = 128, 16384


def fingerprint(text: bytes | None, words_in_shingle: int = 3) -> int:
    """The 64-bit SimHash of one text: a bit is set if set in over half the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *stops[: len(words) - words_in_shingle].tolist()]
    ends = (stops[words_in_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp long)``: the fingerprint as a signed long."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, blocks: int, chosen: int) -> Column:
    """All keys of a fingerprint: each choice of blocks, with its own number so that choices never mix."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), chosen)):
        key = F.lit(n).cast("long")
        for k in choice:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(cut[k])
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    left = np.asarray(fps)
    links = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                links.extend((at.view(np.int64).item(), x) for x in found.view(np.int64).tolist())
    return links


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """``distinct(fp)`` to ``(a, b)``: enough links within ``distance`` bits to connect all that are."""
    ready(distinct.sparkSession)
    blocks, chosen = (5, 2) if distinct.count() <= FEW else (6, 3)
    if distance > blocks - chosen:
        blocks, chosen = distance + 2, 2
    keys = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, chosen)).alias("key"))
    shared = keys.groupBy("key").count().where("count > 1")
    chunk_rows = F.least(F.greatest(F.lit(CELL_LEAST), F.col("count") / 64), F.lit(CELL_MOST))
    cells = (
        keys.join(shared, "key")
        .withColumn("chunks", F.ceil(F.col("count") / chunk_rows).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    cells = spread(cells, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            now = now if held is None else np.concatenate([held, now], axis=1)
            new = np.flatnonzero((now[:3, 1:] != now[:3, :-1]).any(axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield out(now[3, :last], new)
            held = now[:, last:]
        if held is not None:
            yield out(held[3], np.array([held.shape[1]]))

    def out(fps: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(fps).view(np.uint64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        ends = ends[: len(starts)]
        links: list[tuple[int, int]] = []
        if len(fps):
            two = ends - starts == 2
            x, y = fps[starts[two]], fps[starts[two] + 1]
            near = np.bitwise_count(x ^ y) <= distance
            links += zip(x[near].view(np.int64).tolist(), y[near].view(np.int64).tolist(), strict=True)
            for i, j in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
                links += forest(fps[i:j], distance)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return cells.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, words_in_shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id)``, a row for each row of docs.

    A-Z are lower-cased; words are runs without space, tab, newline,
    vertical tab, form feed or return. A null or empty text, or one
    without words, has fingerprint zero, which links like any other.
    Repeated rows and ids each give a row; component_id is the smallest
    id reachable, and null only where all ids of a group are null. An
    empty table gives no rows; other columns are not read.
    """
    fps = written(fingerprints(docs, words_in_shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    labels = components(near_links(distinct.select("fp"), distance))
    rooted = distinct.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each group stays: the one with the smallest id, with all its columns.

    Of rows that repeat that id one stays. Rows with a null id stay, as
    nothing names them.
    """
    groups = simhash_groups(docs, words_in_shingle, distance)
    goes = groups.where("doc_id <> component_id").select("doc_id").distinct()
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    kept = docs.join(goes, "doc_id", "left_anti").select(docs.columns)
    once = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
