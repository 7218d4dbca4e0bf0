"""Exact top-k search by a Voronoi k-nearest-neighbour join.

Pivots split the vectors into groups. Each group's summary holds its size,
its radius, and the distances of the members closest to the pivot, of
k + 1 different ids. By the Cauchy-Schwarz inequality these bound every
inner product of a query with the group from above, and k of them from
below; the sample that the pivots are chosen from gives true products as
a second bound from below. A query is sent only to groups that can still
hold one of its k best. Groups are cut into chunks and their queries into
blocks of bounded size; each cell of the two is solved locally, and the
best of all cells are merged. How many pairs of query and group were kept
is logged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import ready, spread
from siltstone.session import written

#: Pivots at most (the square root of the number of vectors, up to here), vectors they are chosen from.
PIVOTS, SAMPLE = 1024, 4096
#: Vectors of a chunk at least and at most, queries of a block, vectors multiplied at a time.
CHUNK_LEAST, CHUNK_MOST, QUERIES, TILE = 32, 8192, 4096, 1024
EVERY = 50
_log = logging.getLogger(__name__)


def integers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(id, v array<long>)``: floor(256 x) of every vector without a null or non-finite component."""
    x = F.col(column).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).where(~odd)
    return kept.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def matrix(rows: list[list[int]] | pd.Series, width: int) -> np.ndarray:
    """Rows of one width, zeros after the shorter ones."""
    out = np.zeros((len(rows), width), np.float64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Distinct sample vectors, each the farthest from those before."""
    picked = [0] if len(sample) else []
    if len(sample):
        far = ((sample - sample[0]) ** 2).sum(axis=1)
        while len(picked) < n and far.max() > 0:
            k = int(far.argmax())
            picked.append(k)
            far = np.minimum(far, ((sample - sample[k]) ** 2).sum(axis=1))
    return sample[picked] if picked else np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0))


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(id, v)`` with its nearest pivot ``g`` and the distance ``d`` to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), p.shape[1])
            d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)[None, :]
            g = d2.argmin(axis=1)
            d = np.sqrt(((x - p[g]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(g, pa.int32()), pa.array(d, pa.float64())], names=["id", "v", "g", "d"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<long>, g int, d double")


def closest(data: DataFrame, k: int) -> dict[int, list[tuple[float, int]]]:
    """Of each group of ``data(id, g, d)`` the k least distances of different ids: a task cuts its share first."""
    schema = pa.schema([("g", pa.int32()), ("d", pa.float64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            ids, g, d = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((ids, d, g))
            starts = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(g) else []
            for i, j in zip(starts, [*starts[1:], len(g)], strict=True):
                held = best.setdefault(int(g[order[i]]), {})
                met = 0
                seen: set[int] = set()
                for x in order[i:j].tolist():
                    if int(ids[x]) not in seen:
                        seen.add(int(ids[x]))
                        held[int(ids[x])] = min(held.get(int(ids[x]), np.inf), float(d[x]))
                        met += 1
                        if met == k:
                            break
                if len(held) > k:
                    best[int(g[order[i]])] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:k])
        rows = [(g, d, i) for g, held in best.items() for i, d in held.items()]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    rows = data.select("id", "g", "d").mapInArrow(run, "g int, d double, id long").groupBy("g", "id").agg(F.min("d").alias("d"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))).where(F.col("r") <= k)
    found: dict[int, list[tuple[float, int]]] = {}
    for r in rows.select("g", "d", "id").collect():  # at most k rows for each pivot
        found.setdefault(r["g"], []).append((r["d"], r["id"]))
    return found


def top_k(vectors: DataFrame, k: int = 5, every: int = EVERY, key: str = "vec_id", column: str = "embedding", pivots: int | None = None) -> DataFrame:
    """The k highest inner products of each query: (query_id, rank, vec_id, score).

    Queries are the rows whose id is divisible by ``every``; candidates
    all rows but those with the query's id. Ties go to the smaller id. A
    query with fewer candidates gets all. Null ids, null vectors and
    vectors with a null or non-finite component take no part; of vectors
    of unequal length the shorter count as followed by zeros; rows that
    repeat an id are candidates each, and queries each if their vectors
    differ, whose best are merged. No query, no rows. Pivots come from
    ``SAMPLE`` vectors chosen by hash; every vector is indexed, and the
    result is exact. Components must be below 2**20 in size. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = written(integers(vectors, key, column), "vectors")
    shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    n, width = shape["n"], shape["width"]
    out_type = "query_id long, vec_id long, score long"
    share = min(1.0, SAMPLE / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("pivots"), "id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * SAMPLE).toPandas().sort_values("id")
    sample, sample_ids = matrix(chosen["v"].tolist(), width), chosen["id"].to_numpy(np.int64)
    centres = choose_pivots(sample, pivots or max(1, min(PIVOTS, int(n**0.5))))
    data = written(assigned(rows, centres), "groups")
    close = closest(data, k + 1)
    sums = data.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()  # a row for each pivot
    chunk = int(min(CHUNK_MOST, max(CHUNK_LEAST, n // (4 * len(centres)))))
    summary = spark.sparkContext.broadcast((centres, [(r["g"], r["radius"], close[r["g"]]) for r in sums], sample, sample_ids))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that can hold one of a query's k best."""
        p, groups, sample, sample_ids = summary.value
        at = np.array([g for g, _, _ in groups], np.int64)
        radius = np.array([r for _, r, _ in groups])
        owner = np.array([j for j, (_, _, near) in enumerate(groups) for _ in near], np.int64)
        distance = np.array([d for _, _, near in groups for d, _ in near])
        near_ids = np.array([i for _, _, near in groups for _, i in near], np.int64)
        for batch in batches:
            q, ids = matrix(batch.column(1).to_pylist(), p.shape[1]), batch.column(0).to_numpy()
            to_pivot = q @ p[at].T
            size = np.sqrt((q * q).sum(axis=1))
            above = to_pivot + size[:, None] * radius[None, :] + 1e-6 * (1 + np.abs(to_pivot))
            floor = np.full(len(q), -np.inf)
            # k others besides the rows of the query's own id: each group's list and the sample hold different rows
            for below, owners in ((to_pivot[:, owner] - size[:, None] * distance[None, :], near_ids), (q @ sample.T, sample_ids)):
                if below.shape[1] >= k:
                    below[ids[:, None] == owners[None, :]] = -np.inf
                    floor = np.maximum(floor, np.partition(below, -k, axis=1)[:, -k])
            i, j = np.nonzero(above >= (floor - 1e-6 * (1 + np.abs(floor)))[:, None])
            yield pa.record_batch([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(at[j], pa.int32())], names=["id", "v", "g"])

    asked = written(rows.where(F.col("id") % every == 0).distinct().mapInArrow(route, "id long, v array<long>, g int"), "asked")
    counts = {r["g"]: r["count"] for r in asked.groupBy("g").count().collect()}  # a row for each pivot
    _log.info("%d of %d pairs of query and group are kept", sum(counts.values()), shape["q"] * len(sums))
    blocks = {g: -(-m // QUERIES) for g, m in counts.items()}
    chunks = {r["g"]: -(-r["n"] // chunk) for r in sums}
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lookup = spark.createDataFrame([(g, chunks[g], blocks.get(g, 0)) for g in chunks], "g int, chunks int, blocks int")
    lookup = F.broadcast(lookup.where("blocks > 0"))  # a row for each pivot
    x = data.join(lookup, "g").select("id", "v", "g", F.pmod(F.xxhash64("id", "v"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    q = asked.join(lookup, "g").select("id", "v", "g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))

    def solve(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        xs, x = found["id"].to_numpy(), matrix(found["v"].tolist(), width)
        out = []
        for at in range(0, len(queries), TILE):
            qs = queries["id"].to_numpy()[at : at + TILE]
            score = products(matrix(queries["v"].iloc[at : at + TILE].tolist(), width), x)
            score[qs[:, None] == xs[None, :]] = np.iinfo(np.int64).min
            bar = np.partition(score, -k, axis=1)[:, -k] if len(xs) > k else np.full(len(qs), np.iinfo(np.int64).min + 1)
            # the k-th best and its ties, then in order the first k of each query
            i, j = np.nonzero(score >= np.maximum(bar, np.iinfo(np.int64).min + 1)[:, None])
            own = score[i, j]
            order = np.lexsort((xs[j], -own, i))
            i, j, own = i[order], j[order], own[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < k
            out.append((qs[i[kept]], xs[j[kept]], own[kept]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    cell = ["g", "chunk", "block"]
    best = spread(q, *cell).groupBy(*cell).cogroup(spread(x, *cell).groupBy(*cell)).applyInPandas(solve, out_type)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
