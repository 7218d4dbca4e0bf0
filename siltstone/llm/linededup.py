"""Line dedup: segment-partition edit join.

Two lines within ``edits`` edits: of the ``edits + 1`` segments one line
is cut into, one survives whole in the other, at nearly its place. Each
line gives a key for each own segment, with its length, and a key for each
substring that could be a segment of a line as long or slightly shorter
(multi-match-aware selection). Lines that share a key are candidates, and
a banded bit-parallel edit distance verifies them. Equal lines are merged
by hash before. Keys with many lines are cut into cells of a bounded
number of lines that return a spanning forest of their links; keys that
hold a large share of all rows are found on a sample beforehand, which
routes rows and drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import batches_of, fresh, ready, spread
from siltstone.llm.components import components
from siltstone.session import written

#: Edits that near-equal lines may differ by; a line of fewer words and fewer characters than these joins equal lines alone.
EDITS, LEAST_WORDS, LEAST_CHARS = 2, 10, 40
#: What a line joins: nothing if it is blank, equal lines, or near-equal ones too.
BLANK, EQUAL, NEAR = 0, 1, 2
#: Lines of a key up to which all pairs are listed; lines of a chunk beyond that.
FEW, CHUNK = 32, 64
#: The lines of one document in so many are looked at for heavy keys; entries of a task's set of lines met.
SAMPLED, MET = 64, 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def windows(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """The substrings a line of this length is looked up by: (segment number, indexed length, start, end), own segments among them."""
    found = []
    for shorter in range(edits + 1):
        indexed = length - shorter
        if indexed <= edits:
            break
        for k in range(edits + 1):
            i, j = indexed * k // (edits + 1), indexed * (k + 1) // (edits + 1)
            lo = max(0, i - k, i + shorter - (edits - k))
            hi = min(length - (j - i), i + k, i + shorter + (edits - k))
            found += [(k, indexed, s, s + j - i) for s in range(lo, hi + 1)]
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def keys_of(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) for each key of each line; substrings are hashed from sums of powers, so all at once."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(lengths) - lengths
    top = int(lengths.max(initial=0))
    power = np.cumprod(np.full(top + 1, _BASE)) * _INVERSE
    inverse = np.cumprod(np.full(top + 1, _INVERSE)) * _BASE
    at = np.arange(len(code)) - np.repeat(starts, lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(code + np.uint64(1)) * power[at])])
    by_length = {n: np.array(windows(n, edits), np.int64).reshape(-1, 4).T for n in set(lengths.tolist())}
    spans = [by_length[n] for n in lengths.tolist()]
    sizes = np.fromiter((x.shape[1] for x in spans), np.int64, len(spans))
    segment, indexed, first, last = np.concatenate(spans, axis=1) if spans else np.zeros((4, 0), np.int64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    begin = np.repeat(starts, sizes)
    salt = (indexed * 64 + segment).astype(np.uint64)
    h = (sums[begin + last] - sums[begin + first]) * inverse[first]
    return owner, _mixed(_mixed(h) + salt * _BASE).view(np.int64)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: common ends cut off, then a banded bit-parallel distance."""
    if abs(len(a) - len(b)) > edits:
        return False
    i, top = 0, min(len(a), len(b))
    step = 64
    while step:
        while i + step <= top and a[i : i + step] == b[i : i + step]:
            i += step
        step //= 2
    a, b = a[i:], b[i:]
    j, top, step = 0, min(len(a), len(b)), 64
    while step:
        while j + step <= top and a[len(a) - j - step : len(a) - j] == b[len(b) - j - step : len(b) - j]:
            j += step
        step //= 2
    a, b = a[: len(a) - j], b[: len(b) - j]
    if min(len(a), len(b)) <= edits or edits > 31:
        return _plain(a, b) <= edits
    return banded(a, b, edits) <= edits


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def banded(a: str, b: str, edits: int) -> int:
    """Edit distance if at most ``edits`` (31 at most), else some larger number.

    Bit-parallel: a 64-bit window of vertical differences moves down the
    diagonal with its top bit ``edits`` rows below it, then, at the last
    row of ``a``, stays while the row's bit moves down.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > edits:
        return edits + 1
    full = (1 << 64) - 1
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    plus, minus, distance = full << (63 - edits) & full, 0, edits
    low, bit = edits - 63, 1 << 62
    for k, c in enumerate(b):
        eq = places.get(c, 0)
        eq = (eq >> low if low >= 0 else eq << -low) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        if k < len(a) - edits:
            distance += not d0 >> 63
        else:
            distance += bool(hp & bit) - bool(hn & bit)
            bit >>= 1
        plus = (hn | ~(d0 >> 1 | hp)) & full
        minus = d0 >> 1 & hp
        low += 1
    return distance


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines(h, line)`` to ``(key, h)``, a row for each key; equal lines that meet in a task count once."""
    ready(lines.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            rows = []
            for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add(h)
                    rows.append((h, line))
            if rows:
                owner, keys = keys_of([line for _, line in rows], edits)
                yield pa.record_batch([pa.array(keys), pa.array(np.array([h for h, _ in rows], np.int64)[owner])], schema=schema)

    return lines.select("h", "line").mapInArrow(run, "key long, h long")


def candidates(keys: DataFrame) -> DataFrame:
    """``keys(key, h)`` to ``(a, b, key)``: pairs of lines of a short key (key null), or each line of a long one (b null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        sent = None  # a long key that may go on in the next batch
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            if sent is not None:
                stop = int(np.searchsorted(now[0], sent, "right"))
                yield long(now[:, :stop])
                now = now[:, stop:]
                if not now.shape[1]:
                    continue
                sent = None
            now = np.concatenate([held, now], axis=1)
            if not now.shape[1]:
                continue
            cut = int(np.searchsorted(now[0], now[0, -1]))
            yield from all_of(now[:, :cut])
            held = now[:, cut:]
            if held.shape[1] > FEW:
                yield long(held)
                held, sent = held[:, :0], int(held[0, 0])
        yield from all_of(held)

    def long(rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])], schema=schema)

    def all_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        starts = np.concatenate([[0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1])
        size = np.diff(np.append(starts, rows.shape[1]))
        for i, n in zip(starts[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            yield long(rows[:, i : i + n])
        key = np.repeat(np.arange(len(starts)), size)
        few = size[key] <= FEW
        found = []
        for step in range(1, FEW):
            i = np.flatnonzero((key[step:] == key[:-step]) & few[step:]) if step < len(key) else np.zeros(0, np.int64)
            if not len(i):
                break
            found.append(rows[1][np.stack([i, i + step])])
        if found:
            pairs = np.sort(np.concatenate(found, axis=1), axis=0)
            pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], schema=schema)

    return spread(keys, "key").sortWithinPartitions("key", "h").mapInArrow(run, "a long, b long, key long")


def celled(rows: DataFrame) -> DataFrame:
    """``rows(key, h)`` of long keys to ``(key, lo, hi, h)``: each pair of a key's chunks is a cell of bounded size."""
    rows = rows.distinct()
    chunk = F.least(F.greatest(F.lit(CHUNK), F.col("count") / 64), F.lit(4096))
    counts = rows.groupBy("key").count().where("count > 1").withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int"))
    return (
        rows.join(counts, "key")
        .withColumn("own", F.pmod(F.xxhash64("h"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "h")
    )


def cell_links(cells: DataFrame, edits: int) -> DataFrame:
    """``cells(key, lo, hi, h, line)`` to ``(a, b)``: a spanning forest of each cell's links."""

    def forest(cell: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
        hs, lines = zip(*dict(cell).items(), strict=True) if cell else ((), ())
        counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64) for x in lines]) if lines else None
        left = np.arange(len(lines))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                k = queue.pop()
                # an edit changes at most two counts by one
                near = left[np.abs(counts[left] - counts[k]).sum(axis=1) <= 2 * edits]
                found = [j for j in near.tolist() if within(lines[k], lines[j], edits)]
                if found:
                    left = np.setdiff1d(left, found, assume_unique=True)
                    queue += found
                    for j in found:
                        yield hs[k], hs[j]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        at, cell = None, []
        for batch in batches:
            for key, lo, hi, h, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lo, hi) != at:
                    yield from forest(cell)
                    at, cell = (key, lo, hi), []
                cell.append((h, line))
        yield from forest(cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(links(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return spread(cells, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def pair_links(pairs: DataFrame, edits: int) -> DataFrame:
    """``pairs(a, b, x, y)`` whose lines x and y are within ``edits``: ``(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close)], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def has_text(column: str) -> Column:
    """Whether there is anything but white space."""
    return F.col(column).rlike(r"[^\s\p{Z}]")


def split_lines(docs: DataFrame, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, row, line_no, h, kind, line)``: a row for each line, from 0; a null text has none. ``row`` is the text's hash."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    lines = texts.select("doc_id", "row", F.posexplode_outer(F.split("text", "\\n", -1)).alias("line_no", "line"))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    near = (F.length("line") >= least_chars) | (spaces + 1 >= least_words)
    kind = F.when(~has_text("line"), BLANK).when(near, NEAR).otherwise(EQUAL)
    return lines.select("doc_id", "row", "line_no", F.xxhash64("line").alias("h"), kind.alias("kind"), "line")


def line_classes(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """All lines ``(doc_id, row, line_no, h, kind)``, and ``(h, class_id)`` of the lines with near-equal others.

    Null texts have no lines; an empty table gives two empty ones.
    """
    spark = docs.sparkSession
    ready(spark)
    near = F.col("kind") == NEAR
    split = lambda df: split_lines(df, least_words, least_chars)
    lines = written(split(docs).select("doc_id", "row", "line_no", "h", "kind"), "lines")
    texts = split(docs).where(near).select("h", "line")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = split(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)).where(near)
    sample = line_keys(some.select("h", "line"), edits).distinct().groupBy("key").count()
    sample = written(sample.where("count > 1"), "sampled")
    rows = lines.where(near).count() * (3 * edits + 1 + edits * edits)
    # a key on this list holds at least a quarter of a partition's rows, so there are at most four for each partition
    heavy = [r["key"] for r in sample.where(F.col("count") * SAMPLED > max(FEW * SAMPLED, rows / (4 * parts))).select("key").collect()]
    keys = line_keys(texts, edits)
    aside = None
    if heavy:
        hot = F.broadcast(spark.createDataFrame([(k,) for k in heavy], "key long"))
        aside = keys.join(hot, "key", "left_semi").select("key", "h")
        keys = keys.join(hot, "key", "left_anti").select("key", "h")
    found = written(candidates(keys), "candidates")
    pairs = written(found.where("b is not null").select("a", "b").distinct(), "pairs")
    longs = found.where("b is null").select("key", F.col("a").alias("h"))
    cells = written(celled(longs.unionByName(aside) if aside is not None else longs), "cells")
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).union(cells.select("h")).distinct(), "needed")
    owners = lines.join(needed, "h", "left_semi").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    asked = docs.join(written(owners.select("doc_id").distinct(), "owners"), "doc_id", "left_semi")
    held = written(split_lines(asked).select("h", "line").join(needed, "h", "left_semi").dropDuplicates(["h"]), "held")
    x = held.select(F.col("h").alias("a"), F.col("line").alias("x"))
    y = held.select(F.col("h").alias("b"), F.col("line").alias("y"))
    links = pair_links(pairs.join(x, "a").join(y, "b"), edits).unionByName(cell_links(cells.join(held, "h").select("key", "lo", "hi", "h", "line"), edits))
    labels = components(links)
    return lines, labels.select(F.col("node").alias("h"), F.col("root").alias("class_id"))


def judged(docs: DataFrame, edits: int, least_words: int, least_chars: int) -> DataFrame:
    """All lines ``(doc_id, row, line_no, class_id, first_doc_id, first_line_no, keep)``."""
    lines, labels = line_classes(docs, edits, least_words, least_chars)
    named = lines.where(F.col("kind") != BLANK).join(labels, "h", "left").select("doc_id", "row", "line_no", F.coalesce("class_id", "h").alias("class_id"))
    place = F.struct("doc_id", "row", "line_no")
    # lines of a common class shrink to one in every task before they meet
    first = named.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("class_id", "first")
    told = named.join(first, "class_id", "left").withColumn("first", F.coalesce("first", place))
    blank = lines.where(F.col("kind") == BLANK).select("doc_id", "row", "line_no", F.col("h").alias("class_id"), place.alias("first"))
    told = told.unionByName(blank).withColumn("keep", F.col("first") == place)
    return told.select("doc_id", "row", "line_no", "class_id", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), F.coalesce("keep", F.lit(False)).alias("keep"))


def line_dedup(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, line_no, class_id, first_doc_id, first_line_no, keep): a row for each line.

    Lines are cut at newlines. A class holds equal lines of any length
    and those linked by at most ``edits`` edits, for which a line needs
    ``least_words`` words or ``least_chars`` characters. A line of white
    space is its own class and always stays. Of a class the line of the
    smallest doc_id stays, nulls first; of texts that share an id the one
    with the smaller hash comes first, and rows equal in id and text are
    one document: their lines have one fate. Null texts have no lines; an
    empty text has one empty line. An empty table gives no rows; other
    columns are not read. Equal lines are told by a 64-bit hash.
    """
    return judged(docs, edits, least_words, least_chars).drop("row")


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Documents without the lines that repeat earlier ones, with all their columns.

    n_chars, where there is such a column, is set to the new length. A
    document that loses lines and has nothing but white space left goes; it is the
    first of no class, as blank lines join none. One that loses no line
    stays as it is, as does a null or empty text. Of rows equal in doc_id
    and text one stays; rows that share an id alone, or have none, are
    told apart by their texts. An empty table gives no rows.
    """
    doc_id, row, gone, text = (fresh(docs.columns, x) for x in ("id__", "row__", "gone__", "text__"))
    dropped = judged(docs, edits, least_words, least_chars).where(~F.col("keep"))
    dropped = dropped.groupBy(F.col("doc_id").alias(doc_id), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    of, own = F.col("doc_id").cast("long"), F.xxhash64("text")
    again = docs.where("text is not null").groupBy(of.alias(doc_id), own.alias(row)).count().where("count > 1").select(doc_id, row)
    same = of.eqNullSafe(F.col(doc_id)) & (own == F.col(row))
    twice = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    out = docs.join(again, same, "left_anti").unionByName(twice).join(dropped, same, "left")
    rest = F.array_join(F.filter(F.split("text", "\\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    out = out.where(F.col("text").isNull() | F.col(gone).isNull() | has_text(text))
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.col(text)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(v.alias(c) for c, v in columns.items()))
