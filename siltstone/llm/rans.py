"""Token-id files: static range asymmetric numeral system (rANS).

One table of frequencies, counted over all tokens and scaled to a power
of two, serves every block. A block holds a run of documents of one part
in ascending id order: a header, the documents' ids and lengths, and the
tokens in interleaved lanes. Lanes are independent coder states that step
together, so encoding and decoding are array operations; between
checkpoints lies a bounded number of steps, and each checkpoint has its
own states, words and checksum, so segments of a block, blocks and parts
all decode in parallel. Blocks are rows of a Parquet table in the shared
workspace, as executors have no other common file writer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import ready
from siltstone.llm.tokens import Encoder, binaries, numbers, tokenized, tokenizer_json
from siltstone.session import table_path, written

MAGIC = b"STRA"
VERSION = 1
#: Bits of the frequency scale, lanes of a segment, tokens of a segment (between checkpoints) and of a block.
SCALE_BITS, LANES, SEGMENT, BLOCK = 20, 1024, 1 << 18, 1 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIQQI")
_SEG = struct.Struct("<IIII")


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts to frequencies that sum to ``2**bits``, at least 1 where a count is above 0.

    The excess or lack that rounding leaves goes to the most frequent ids.
    """
    total, room = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > room:
        raise ValueError("more distinct ids than the scale has places")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = room - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    while left < 0:
        for i in order:
            if freq[i] <= 1:
                break
            take = min(-left, int(freq[i] - 1) // 2 + 1, int(freq[i] - 1))
            freq[i] -= take
            left += take
            if left == 0:
                break
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes segments by one table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None
        self.limit = self.freq << np.uint64(31 - bits + 32)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        """One segment: counts, lane states, words, and the checksum of the ids."""
        n = len(ids)
        lanes = max(1, min(lanes, n))
        state = np.full(lanes, _LOW, np.uint64)
        steps = -(-n // lanes)
        words: list[np.ndarray] = []
        freq, start, limit = self.freq[ids], self.start[ids], self.limit[ids]
        for k in range(steps - 1, -1, -1):  # the decoder then runs forwards
            i, j = k * lanes, min(n, (k + 1) * lanes)
            x, f = state[: j - i], freq[i:j]
            full = x >= limit[i:j]
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: j - i] = (q << self.bits) + (x - q * f) + start[i:j]
        body = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
        return _SEG.pack(n, lanes, len(body), zlib.crc32(ids.astype("<u4").tobytes())) + state.astype("<u8").tobytes() + body.astype("<u4").tobytes()

    def decode(self, data: memoryview) -> tuple[np.ndarray, int]:
        """The ids of the segment at the start of ``data``, and the bytes it took."""
        n, lanes, count, crc = _SEG.unpack_from(data)
        at = _SEG.size
        state = np.frombuffer(data, "<u8", lanes, at).astype(np.uint64)
        words = np.frombuffer(data, "<u4", count, at + 8 * lanes).astype(np.uint64)
        out = np.empty(n, np.uint32)
        slots, pos = self.slots, 0
        for i in range(0, n, lanes):
            j = min(n, i + lanes)
            x = state[: j - i]
            slot = x & self.mask
            ids = slots[slot.astype(np.int64)]
            out[i:j] = ids
            x = self.freq[ids] * (x >> self.bits) + slot - self.start[ids]
            low = x < _LOW
            m = int(np.count_nonzero(low))
            if m:
                x[low] = (x[low] << np.uint64(32)) | words[pos : pos + m]
                pos += m
            state[: j - i] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != crc or pos != count:
            raise ValueError("a segment's checksum does not match")
        return out, at + 8 * lanes + 4 * count


def pack_block(coder: Coder, part: int, start: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block's bytes: header with checksum, documents (id, null flag, length), checkpoints, segments."""
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + lengths.astype("<u8").tobytes()
    segments = [coder.encode(ids[i : i + SEGMENT]) for i in range(0, len(ids), SEGMENT)]
    checkpoints = np.cumsum([0, *map(len, segments)])[:-1].astype("<u8").tobytes()
    body = docs + checkpoints + b"".join(segments)
    return _HEAD.pack(MAGIC, VERSION, part, len(doc_ids), len(segments), start, len(ids), zlib.crc32(body)) + body


def unpack_block(coder: Coder, block: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(part, start, doc ids, lengths, ids) of a block; a wrong checksum is an error."""
    magic, version, part, docs, segments, start, total, crc = _HEAD.unpack_from(block)
    view = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(view) != crc:
        raise ValueError("not a block of this format, or a damaged one")
    ids = np.frombuffer(view, "<i8", docs)
    null = np.frombuffer(view, "u1", docs, 8 * docs)
    lengths = np.frombuffer(view, "<u8", docs, 9 * docs).astype(np.int64)
    points = np.frombuffer(view, "<u8", segments, 17 * docs)
    data = view[17 * docs + 8 * segments :]
    found = [coder.decode(data[int(p) :])[0] for p in points]
    tokens = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if len(tokens) != total:
        raise ValueError("a block's length does not match")
    return part, start, [None if z else int(d) for d, z in zip(ids, null, strict=True)], lengths, tokens


def token_counts(ids: DataFrame, size: int, kind: str = "<u4") -> np.ndarray:
    """How often each of ``size`` ids occurs in all rows; a task sends at most ``size`` sums."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(numbers(batch.column(0), kind)[0], minlength=size)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], schema=schema)

    counts = np.zeros(size, np.int64)
    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most `size` rows
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Encode ``docs(doc_id, text)`` into ``folder``: tables ``frequencies`` and ``blocks``.

    Documents are in ascending doc_id order, nulls first, and rows that
    share an id in the order of their texts. A null text counts as empty;
    an empty text is the end id alone; an empty table gives an empty
    table of blocks. Long texts run over as many segments as they need.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ids = written(tokenized(ordered, ["doc_id"], end_id, tokenizer), "ids")
    encoder = Encoder(tokenizer_json(tokenizer), end_id)
    kind = encoder.kind
    freq = scaled(token_counts(ids, encoder.size, kind))
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")
    totals = ids.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).toPandas().sort_values("part")  # a row for each part
    base = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((freq, base))
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("docs", pa.int32()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        coder = Coder(freq)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            part, start = rows[0][1], rows[0][2]
            lengths = np.array([r[3] for r in rows], np.int64)
            tokens = np.frombuffer(b"".join(r[4] for r in rows), kind).astype("<u4")
            first = base[part] + start
            block = pack_block(coder, part & 0xFFFF, first, [r[0] for r in rows], lengths, tokens)
            batch = pa.record_batch([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([block], pa.binary())], schema=schema)
            rows.clear()
            return batch

        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (rows[-1][1] != row[1] or rows[-1][2] + rows[-1][3] != row[2] or held + row[3] > BLOCK):
                    yield out()
                    held = 0
                rows.append(row)
                held += row[3]
        if rows:
            yield out()

    ids.select("doc_id", "part", "start", "n_tokens", "ids").mapInArrow(run, "part int, start long, docs int, block binary").write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of every document in a folder's files."""
    ready(spark)
    rows = spark.read.parquet(f"{folder}/frequencies").toPandas()  # at most the vocabulary's size
    size = int(rows["id"].max()) + 1 if len(rows) else 1
    freq = np.zeros(size, np.uint32)
    if len(rows):
        freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                _, start, doc_ids, lengths, tokens = unpack_block(coder, block)
                ends = np.cumsum(lengths)
                yield pa.record_batch(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), binaries(tokens.astype("<u4"), lengths)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{folder}/blocks").select("block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to files in the workspace, and what the files then hold, a row for each document."""
    folder = table_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, end_id, tokenizer)
    return read_token_files(docs.sparkSession, folder)
