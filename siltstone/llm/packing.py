"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. In every round each source's deficit
grows by its share of a window, and it is served whole quanta of tokens
as far as the deficit reaches; the rest is carried to the next round.
After ``r`` rounds a source has been served ``floor(r * share * window /
quantum)`` quanta, so any task knows the deficits at any round without
the rounds before: each document is cut where its source's rounds end,
rounds are laid one after another, and windows are cut from that stream.
Sources without a target follow, mixed by their own sizes; what a queue
has left beyond its last whole quantum comes at the end, where the last
tokens go into windows whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import ready
from siltstone.llm.tokens import binaries, gathered, id_type, numbers, tokenized
from siltstone.session import written

#: Tokens of a window, and of a quantum, which divides it: with one token every window keeps the shares to within a token of each source.
WINDOW, QUANTUM = 2048, 1


def leftover(total: int, window: int) -> list[tuple[int, int]]:
    """Where the last, partial window is cut: (start, end) of its powers of two, largest first."""
    at, cuts = total - total % window, []
    for bit in reversed(range(window.bit_length())):
        if total % window >> bit & 1:
            cuts.append((at, at + (1 << bit)))
            at += 1 << bit
    return cuts


def rounds_of(start: int, end: int, whole: int, num: int, den: int, last: int, quantum: int) -> list[tuple[int, int, int, int]]:
    """How tokens ``start`` to ``end`` of a queue fall into rounds: (round, tokens of the round before, start, length).

    The queue is served ``r * num // den`` quanta by the start of round
    ``r``, ``whole`` quanta in all; what lies beyond is in round ``last``.
    """
    found = []
    while start < end:
        k = start // quantum
        if k >= whole:
            found.append((last, start - whole * quantum, start, end - start))
            break
        r = -(-(k + 1) * den // num) - 1
        stop = min(end, min(whole, (r + 1) * num // den) * quantum)
        found.append((r, start - min(whole, r * num // den) * quantum, start, stop - start))
        start = stop
    return found


def schedule(weights: dict[str, float], own: dict[str, int], slots: int) -> tuple[dict[str, list[tuple[int, int, int, int]]], int]:
    """The phases of each source with a target, and how many rounds they take.

    A phase (first round, quanta served before, and by its end, quanta a
    round in units of 2**-20) ends when a source runs out; the others
    then share its room, so that rounds stay as long as a window.
    """
    active = {q: w for q, w in weights.items() if own.get(q)}
    plan: dict[str, list] = {q: [] for q in active}
    served, at = dict.fromkeys(active, 0), 0
    while active:
        scale = sum(active.values())
        rate = {q: max(1, round(w / scale * slots * (1 << 20))) for q, w in active.items()}
        rounds = min(-(-((own[q] - served[q]) << 20) // rate[q]) for q in active)
        for q in active:
            upto = min(own[q], served[q] + (rounds * rate[q] >> 20))
            plan[q].append((at, served[q], upto, rate[q]))
            served[q] = upto
        at += rounds
        active = {q: w for q, w in active.items() if served[q] < own[q]}
    return plan, at


def pack(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    end_id: int = 1,
    tokenizer: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """``docs(doc_id, source, text)`` to pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids if asked for.

    ``targets`` gives sources their share of a window. A window keeps
    them to within ``quantum`` tokens of each source; one that runs out
    leaves its room to the others, in proportion, and sources without a
    target, or with none above 0, follow when all are done, by their
    sizes. Without ``targets``, shares are those of all tokens,
    which every window then keeps to the end. A null source and a null or
    empty text count as the empty string; such a text is the end id
    alone. Rows that repeat are packed as often as they occur. Extra
    columns are not read; an empty table gives no pieces.
    """
    if window % quantum or window & (window - 1):
        raise ValueError("the window must be a power of two and a multiple of the quantum")
    spark = docs.sparkSession
    ready(spark)
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("q"), "text")
    ids = written(tokenized(rows, ["doc_id", "q"], end_id, tokenizer, group="q"), "ids")
    sums = written(ids.groupBy("q", "part").agg(F.sum("n_tokens").alias("n")), "sums")
    before = Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = sums.select("q", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    queues = sums.groupBy("q").agg(F.sum("n").alias("n")).select("q", F.floor(F.col("n") / quantum).alias("whole"), F.col("n"))
    sizes = queues.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("whole"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    whole, total = int(sizes["whole"]), int(sizes["n"])
    slots = window // quantum
    shares = {q: w for q, w in (targets or {}).items() if w > 0}
    named = {r["q"]: int(r["whole"]) for r in queues.where(F.col("q").isin(list(shares))).collect()} if shares else {}  # a row for each target at most
    plan, first = schedule(shares, named, slots)
    rest = whole - sum(named.values())
    last = first + -(-rest // slots)
    segment = pa.schema([("round", pa.int64()), ("q", pa.int64()), ("into", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for uid, q, key, at, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phases = [(r, lo, hi, rate, 1 << 20) for r, lo, hi, rate in plan[q]] if q in plan else [(first, 0, own, slots * own, rest)]
                for r0, lo, hi, num, den in phases:
                    lo, stop = lo * quantum, at + n if hi == own else min(at + n, hi * quantum)  # the last phase has the tail too
                    for r, into, s, length in rounds_of(max(at, lo) - lo, stop - lo, hi - lo // quantum, num, den, last - r0 + key % 1024, quantum):
                        out.append((r0 + r, key, into, uid, s + lo - at, length))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=segment)

    placed = ids.select("uid", "q", "part", "start", "n_tokens").join(base, ["q", "part"]).join(queues.select("q", "whole"), "q")
    placed = placed.select("uid", "q", F.xxhash64("q").alias("key"), (F.col("base") + F.col("start")).alias("at"), "n_tokens", "whole")
    segments = written(placed.mapInArrow(cut, "round long, q long, into long, uid long, start long, length long"), "segments")
    # the tokens before each round, in two levels: no task adds up all rounds
    wide = max(1, int((last + 1024) ** 0.5))
    rounds = segments.groupBy("round").agg(F.sum("length").alias("n")).withColumn("bucket", F.floor(F.col("round") / wide))
    buckets = rounds.groupBy("bucket").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bucket_base"))
    inside = Window.partitionBy("bucket").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.join(buckets, "bucket").select("round", (F.col("bucket_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("round_base"))
    turn = Window.partitionBy("round").orderBy("q", "into", "uid", "start").rowsBetween(Window.unboundedPreceding, -1)
    laid = segments.withColumn("within", F.coalesce(F.sum("length").over(turn), F.lit(0))).join(rounds, "round")
    laid = laid.groupBy("uid").agg(F.collect_list(F.struct("start", "length", (F.col("round_base") + F.col("within")).alias("at"))).alias("segments"))
    tail = leftover(total, window)
    types = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), *([("ids", "binary")] if with_ids else [])]
    piece = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in types])
    full = total // window
    kind = id_type(tokenizer, end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, stops = numbers(batch.column(2), kind)
            ids = ids.astype("<u4")
            found = batch.column(3)
            start, length, at = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("start", "length", "at"))
            doc = np.repeat(np.arange(len(stops)), found.value_lengths().to_numpy(zero_copy_only=False))
            # a segment gives a piece for each window it touches
            first = at // window
            many = (at + length - 1) // window - first + 1
            own = np.repeat(np.arange(len(at)), many)
            number = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            low, high = number * window, (number + 1) * window
            for a, b in reversed(tail):  # the last, partial window is cut again
                split = np.flatnonzero((number == full) & (high > a) & (at[own] + length[own] > a) & (low < a))
                own, number = np.append(own, own[split]), np.append(number, number[split])
                low, high = np.append(low, np.full(len(split), a)), np.append(high, high[split])
                high[split] = a
            begin, end = np.maximum(at[own], low), np.minimum((at + length)[own], high)
            fit = end > begin
            own, number, low, begin, end = own[fit], number[fit], low[fit], begin[fit], end[fit]
            for k, (a, _) in enumerate(tail):
                inside = begin >= a
                number[inside], low[inside] = full + k, a
            s, n, of = start[own] + begin - at[own], end - begin, doc[own]
            place = (stops - np.diff(stops, prepend=0))[of] + s
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(place.tolist(), (place + n).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(of)), s, n, crc, batch.column(1).take(pa.array(of)), number, begin - low]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                columns.append(binaries(gathered(ids, place, n), n))
            yield pa.record_batch(columns, schema=piece)

    joined = ids.select("uid", "doc_id", "n_tokens", "ids").join(laid, "uid").select("doc_id", "n_tokens", "ids", "segments")
    return joined.mapInArrow(pieces, ", ".join(f"`{n}` {t}" for n, t in types))
