"""Whole-text tokenization by the tokenizers library, with a bounded table of the parts met.

A byte-level BPE cuts text into parts before merging, and no merge crosses
a cut. Some cuts can be told from the bytes alone: a run of white space
followed by something else is cut before its last character, which, if a
space, belongs to the part that follows; and a mark after a letter begins
a new part. So a batch of texts is cut there by array operations, each
distinct piece is encoded by the library once, and its ids are kept in an
open-addressing table of arrays, looked up for all pieces at once. Texts
with white space beyond ASCII, or with the string of an added token, are
encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "byte_bpe_50k.json"
#: Pieces a worker's table holds, eight-byte words of a piece that is kept, and bytes of text cut at a time.
CAPACITY, WIDTH, SLICE = 1 << 20, 3, 1 << 19
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file's text; read on the driver and sent along, so executors need no such file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(256 + others.index(b)) for b in others}


_BYTES = _byte_letters()


def is_space(b: np.ndarray) -> np.ndarray:
    """Tab, line feed, vertical tab, form feed, return or space; differences wrap, so one comparison tests a range."""
    return (b == 0x20) | ((b - np.uint8(9)) < 5)


def is_letter(b: np.ndarray) -> np.ndarray:
    return ((b | np.uint8(32)) - np.uint8(97)) < 26


def other_space(b: np.ndarray) -> np.ndarray:
    """Places of white space that is not ASCII, or of a separator that some count as such."""
    # the separators 0x1C to 0x1F, and the first bytes of U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000
    at = np.flatnonzero(((b - np.uint8(0x1C)) < 4) | (b == 0xC2) | ((b - np.uint8(0xE1)) < 3))
    if not len(at):
        return at
    end = len(b) - 1
    one, two, three = b[at], b[np.minimum(at + 1, end)], b[np.minimum(at + 2, end)]
    found = one < 0x20
    found |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    found |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
    found |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    found |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
    found |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return at[found]


def cuts(b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at ``firsts``, ascending."""
    n = len(b)
    space = is_space(b)
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    edge = begins[1:].copy()  # the byte is the last of its text
    edge[-1] = True
    begin = begins[:n]
    last = space.copy()  # of a run of white space the last character, where something else follows
    last[:-1] &= ~space[1:]
    last &= ~edge
    after = np.zeros(n, bool)  # what follows white space that is no plain space
    after[1:] = last[:-1] & (b[:-1] != 0x20)
    run = space.copy()  # the first character of a run
    run[1:] &= ~space[:-1] | begin[1:]
    letter = is_letter(b)
    latin = (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)  # with 0xC3 before it, a letter
    latin[1:] &= b[:-1] == 0xC3
    latin[:1] = False
    mark = np.zeros(n, bool)
    mark[1:] = ((b - np.uint8(33)) < 94)[1:]
    mark &= ~letter & ~((b - np.uint8(48)) < 10)
    mark[1:] &= letter[:-1] | latin[:-1]
    return np.flatnonzero(begin | last | after | run | mark)


class Table:
    """Pieces of up to ``8 * WIDTH`` bytes and their ids, as arrays; pieces unused since the last clearing go when it is full."""

    def __init__(self, kind: str):
        self.kind = kind
        self.slots = np.full(2 * CAPACITY, -1, np.int32)
        self.keys = np.zeros((WIDTH + 1, CAPACITY), np.uint64)
        self.at, self.count = np.zeros(CAPACITY, np.int64), np.zeros(CAPACITY, np.int64)
        self.used = np.zeros(CAPACITY, bool)
        self.pool = np.zeros(1 << 16, kind)
        self.size = self.filled = 0

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        h = keys[WIDTH] * _C
        for k, salt in zip(range(WIDTH), (_A, _B, _C), strict=True):
            h = (h ^ keys[k]) * salt
            h ^= h >> np.uint64(29)
        return h

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot = (h & np.uint64(2 * CAPACITY - 1)).astype(np.int64)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & ~self._same(found, keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (2 * CAPACITY - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & ~self._same(found[wrong], keys[:, wrong])]
        return found

    def _same(self, entry: np.ndarray, keys: np.ndarray) -> np.ndarray:
        same = self.keys[0][entry] == keys[0]
        for k in range(1, WIDTH + 1):
            same &= self.keys[k][entry] == keys[k]
        return same

    def room(self, n: int) -> None:
        """Make room for ``n`` entries; entries change their numbers."""
        if self.size + n <= CAPACITY:
            return
        stay = np.flatnonzero(self.used[: self.size])
        if len(stay) + n > CAPACITY // 2:
            stay = stay[:0]
        keys, at, count = self.keys[:, stay], self.at[stay], self.count[stay]
        ids = gathered(self.pool, at, count)
        self.slots[:] = -1
        self.size = self.filled = 0
        self.add(keys, self.hashed(keys), count, ids)
        self.used[:] = False

    def add(self, keys: np.ndarray, h: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new keys and their ids, one key's after another's; there must be room."""
        n = keys.shape[1]
        new = slice(self.size, self.size + n)
        self.keys[:, new] = keys
        self.count[new] = count
        self.at[new] = self.filled + np.cumsum(count) - count
        self.used[new] = False
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.kind)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        entry, slot = np.arange(self.size, self.size + n, dtype=np.int32), (h & np.uint64(2 * CAPACITY - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of those that want one slot the last gets it
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (2 * CAPACITY - 1)
        self.size += n


def gathered(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``pool[at : at + count]`` one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at - (ends - count), count) + np.arange(total)]


class Encoder:
    """Texts to ids by a tokenizers file, as the library gives them without added special tokens.

    Ids are little-endian numbers of ``kind``, the narrowest that holds
    the vocabulary and ``end_id``.
    """

    def __init__(self, json_text: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.size = max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.end = np.array([] if end_id is None else [end_id], self.kind)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = self.tokenizer.pre_tokenizer
        #: Whether pieces may be encoded one by one.
        self.plain = type(before).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not before.add_prefix_space
        self.model = self.tokenizer.model.tokenize if self.plain else None
        self.table = Table(self.kind) if self.plain else None

    def piece(self, text: str) -> list[int]:
        """Ids of a piece, by the library: letters after at most one space are one part, others are cut by it."""
        letters = text[1:] if text[0] == " " else text
        if letters.isalpha() or letters in (".", ","):
            mapped = ["Ġ" + letters if text[0] == " " else letters] if text.isascii() else [text.encode().decode("latin-1").translate(_BYTES)]
        else:
            mapped = [m for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return [x.id for m in mapped for x in self.model(m)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: of the empty text) one after another, the end id after each, and how many each has."""
        ids, counts = [], []
        for k, n in slices(texts):
            found, own = self._encode(texts.slice(k, n))
            ids.append(found)
            counts.append(own)
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, stops = numbers(texts, "u1")
        firsts = stops - np.diff(stops, prepend=0)
        if not self.plain:
            own = [np.append(self.whole(x or ""), self.end).astype(self.kind) for x in texts.to_pylist()]
            return np.concatenate(own), np.array([len(x) for x in own], np.int64)
        if len(data) > SLICE:  # one long text
            found = self._long(data)
            return np.append(found, self.end).astype(self.kind), np.array([len(found) + len(self.end)], np.int64)
        odd = np.zeros(len(stops), bool)
        odd[np.searchsorted(stops, other_space(data), "right")] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(stops, at, "right")] = True
                at = raw.find(token, at + 1)
        special = [self.whole(raw[firsts[t] : stops[t]].decode()) for t in np.flatnonzero(odd).tolist()]
        full = stops > firsts
        start = cuts(data, firsts[full]) if len(data) else np.zeros(0, np.int64)
        of = np.searchsorted(stops, start, "right")  # the text of each piece
        stop = np.append(start[1:], len(data))
        if special:
            fit = ~odd[of]
            start, stop, of = start[fit], stop[fit], of[fit]
        pool, at, count = self._pieces(raw, data, start, stop)
        # after the pieces of a text come what it holds if encoded whole, and the end
        base = len(pool)
        pool = np.concatenate([pool, self.end, *special]).astype(self.kind, copy=False)
        sizes = np.array([len(x) for x in special], np.int64)
        place = np.searchsorted(of, np.arange(len(stops)), "right")
        extra_at = np.full((2, len(stops)), base, np.int64)
        extra_n = np.zeros((2, len(stops)), np.int64)
        extra_at[0, odd] = base + len(self.end) + np.cumsum(sizes) - sizes
        extra_n[0, odd] = sizes
        extra_n[1] = len(self.end)
        at, n = np.insert(at, np.repeat(place, 2), extra_at.T.ravel()), np.insert(count, np.repeat(place, 2), extra_n.T.ravel())
        ids = gathered(pool, at, n)
        return ids, np.bincount(of, count, len(stops)).astype(np.int64) + extra_n.sum(axis=0)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A long text in slices that begin at a lone space between other characters; whole if there is none."""
        raw = data.tobytes()
        if len(other_space(data)) or any(t in raw for t in self.added):
            return self.whole(raw.decode())
        space = is_space(data)
        safe = np.flatnonzero((data[1:-1] == 0x20) & ~space[:-2] & ~space[2:]) + 1
        edges = [0]
        while len(data) - edges[-1] > SLICE:
            k = int(np.searchsorted(safe, edges[-1] + SLICE, "right")) - 1
            if k < 0 or safe[k] <= edges[-1]:
                return self.whole(raw.decode())
            edges.append(int(safe[k]))
        found = []
        for i, j in zip(edges, [*edges[1:], len(data)], strict=True):
            part = data[i:j]
            start = cuts(part, np.zeros(1, np.int64))
            pool, at, count = self._pieces(raw[i:j], part, start, np.append(start[1:], len(part)))
            found.append(gathered(pool, at, count))
        return np.concatenate(found)

    def _pieces(self, raw: bytes, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each piece's are and how many."""
        padded = np.concatenate([data, np.zeros(8 * (WIDTH + 1), np.uint8)])
        eights = np.ndarray(len(data) + 8 * WIDTH, "<u8", padded, strides=(1,))
        length = stop - start
        short = length <= 8 * WIDTH
        i, n = (start, length) if short.all() else (start[short], length[short])
        keys = np.empty((WIDTH + 1, len(i)), np.uint64)
        for k in range(WIDTH):
            keys[k] = eights[i + 8 * k] & _KEEP[np.clip(n - 8 * k, 0, 8)]
        keys[WIDTH] = n
        h = Table.hashed(keys)
        table = self.table
        entry = table.find(keys, h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            if table.size + len(first) > CAPACITY:
                table.room(len(first))
                entry = table.find(keys, h)
                new = np.flatnonzero(entry < 0)
                _, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            fresh = new[first]
            found = [self.piece(raw[a : a + m].decode()) for a, m in zip(i[fresh].tolist(), n[fresh].tolist(), strict=True)]
            base = table.size
            table.add(keys[:, fresh], h[fresh], np.fromiter(map(len, found), np.int64, len(found)), np.array([x for ids in found for x in ids], self.kind))
            entry[new] = base + inverse
            twins = new[(keys[:, new] != keys[:, fresh][:, inverse]).any(axis=0)]  # other pieces of one hash
        else:
            twins = new
        table.used[entry] = True
        pool, at, count = table.pool[: table.filled], table.at[entry], table.count[entry]
        rest = np.flatnonzero(~short)
        if len(rest) or len(twins):
            all_at, all_n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            all_at[short], all_n[short] = at, count
            rest = np.concatenate([rest, np.flatnonzero(short)[twins]])
            found = [self.piece(raw[a:b].decode()) for a, b in zip(start[rest].tolist(), stop[rest].tolist(), strict=True)]
            own = np.fromiter(map(len, found), np.int64, len(found))
            all_at[rest], all_n[rest] = len(pool) + np.cumsum(own) - own, own
            pool, at, count = np.concatenate([pool, np.array([x for ids in found for x in ids], self.kind)]), all_at, all_n
        return pool, at, count


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (first, number) of texts of at most ``SLICE`` bytes together, or of one text."""
    _, stops = numbers(texts, "u1")
    k = 0
    while k < len(stops):
        before = int(stops[k - 1]) if k else 0
        n = max(1, int(np.searchsorted(stops, before + SLICE, "right")) - k)
        yield k, n
        k += n


_encoders: dict[tuple, Encoder] = {}


def encoder_of(shared, end_id: int) -> Encoder:
    """This worker's encoder for a broadcast vocabulary; kept between tasks with its table."""
    text = shared.value
    key = hash(text), end_id
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text, end_id)
    return _encoders[key]


def numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The content of a string or binary column's rows as numbers one after another, and each row's end; nothing is copied."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data if data is not None else b"", kind, int(at[-1] - at[0]) // size, int(at[0])), (at[1:] - at[0]).astype(np.int64) // size


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of numbers as a binary column."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * ids.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def id_type(path: str | None = None, end_id: int = 0) -> str:
    """The narrowest type that holds all ids: rows of ids are moved and stored in it."""
    return Encoder(tokenizer_json(path), end_id).kind


def tokenized(docs: DataFrame, columns: list[str], end_id: int, path: str | None = None, group: str | None = None) -> DataFrame:
    """``columns`` and ``text`` to ``columns``, uid, part, start, n_tokens, ids (in ``id_type``), in the order of the rows.

    ``uid`` tells rows apart, ``part`` is the task's number and ``start`` the tokens before the row
    in its task, or in its task and ``group`` where one is named.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json(path))
    types = dict(docs.dtypes)
    ddl = "".join(f"`{c}` {types[c]}, " for c in columns) + "uid long, part int, start long, n_tokens long, ids binary"
    at = columns.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(shared, end_id)
        before: dict = {}
        row = part << 40
        for batch in batches:
            ids, n = encoder.encode(batch.column(len(columns)).fill_null(""))
            starts = []
            for key, k in zip(batch.column(at).to_pylist() if at is not None else [None] * len(n), n.tolist(), strict=True):
                starts.append(before.get(key, 0))
                before[key] = starts[-1] + k
            uid = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.record_batch(
                [*batch.columns[: len(columns)], uid, pa.array(np.full(len(n), part), pa.int32()), pa.array(starts, pa.int64()), pa.array(n), binaries(ids, n)],
                names=[*columns, "uid", "part", "start", "n_tokens", "ids"],
            )

    return docs.select(*columns, "text").mapInArrow(run, ddl)
