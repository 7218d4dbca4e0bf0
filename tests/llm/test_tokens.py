"""Token ids against a fresh tokenizer of the library, and packing and token files against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, rans, tokens
from siltstone.llm.tokens import Encoder, tokenizer_json


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def split(ids, counts):
    stops = np.cumsum(counts)
    return [ids[i:j].tolist() for i, j in zip(stops - counts, stops, strict=True)]


def encoded(encoder, texts):
    return split(*encoder.encode(pa.array(texts, pa.string()).fill_null("")))


def test_encoder_is_exact(library):
    encoder, r = Encoder(tokenizer_json(), 2), random.Random(4)
    letters = list("abzéñßЖ漢0٣ \n\t\r  .,'s!-_😀ª²×÷…“\x1c\x0b") + ["don't", " the", "A.B.", "<|endoftext|>", "  ", "\n\n", "averyveryverylongwordindeed"]
    for _ in range(300):
        some = letters[: r.randint(3, len(letters))]
        texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(30)] + [None, ""]
        assert encoded(encoder, texts) == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert library.encode("x <|endoftext|> y", add_special_tokens=False).ids == encoded(Encoder(tokenizer_json()), ["x <|endoftext|> y"])[0]


def test_long_texts_and_a_full_table(library, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 200)
    monkeypatch.setattr(tokens, "CAPACITY", 64)
    encoder, r = Encoder(tokenizer_json()), random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(n)) for n in (3, 400, 1, 30, 700, 5)] + ["x" * 900, "a b " * 200]
    assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.table.size <= 64


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = Encoder(tokenizer_json(path), 7), Tokenizer.from_file(path)
    assert not encoder.plain
    texts = ["Some Words, here", None, ""]
    assert encoded(encoder, texts) == [plain.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def rows_of(spark):
    r = random.Random(9)
    words = "alpha beta gamma, delta. epsilon zeta".split()
    rows = [(k, "a" if k % 3 else "b", " ".join(r.choice(words) for _ in range(r.randint(1, 900)))) for k in range(60)]
    rows += [(70, None, "no source"), (71, "c", None), (72, "c", ""), (5, "a", "the id again <|endoftext|> here"), (5, "a", "the id again <|endoftext|> here"), (None, "b", "no id"), (73, "d", "long " * 9000)]
    return rows, spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, source string, text string, start long, q long").repartition(3)


def test_token_files(spark, library):
    rows, docs = rows_of(spark)
    expected, at = [], 0
    for i, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = [(r["doc_id"], r["start"], bytes(r["ids"])) for r in rans.round_trip(docs).collect()]
    assert Counter(got) == Counter(expected)


@pytest.mark.parametrize("targets,quantum", [(None, 1), (None, 64), ({"a": 3.0, "b": 1.0, "none": 2.0}, 1), ({"a": 1.0, "d": 1.0}, 16), ({"a": 0.0}, 1)])
def test_packing(spark, library, targets, quantum):
    rows, docs = rows_of(spark)
    window = 256
    got = packing.pack(docs, targets, window, quantum, 1).collect()
    ids = {k: library.encode(text or "", add_special_tokens=False).ids + [1] for k, (_, _, text) in enumerate(rows)}
    for p in got:
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
    # each document's pieces join to its ids; the two equal rows have the same pieces' content twice
    own = {}
    for p in got:
        own.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for key in {r[0] for r in rows}:
        wanted = [ids[k] for k, r in enumerate(rows) if r[0] == key]
        held = Counter()
        for start, raw, n in own[key]:
            held.update((start + j, x, n) for j, x in enumerate(np.frombuffer(raw, "<u4").tolist()))
        assert held == Counter((j, x, len(w)) for w in wanted for j, x in enumerate(w))
    # sequences are numbered without gaps, filled from 0 without gaps, and whole but for the last few
    sequences = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, ids.values()))
    sizes = []
    for k in sorted(sequences):
        at = 0
        for p in sorted(sequences[k], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert sizes[: total // window] == [window] * (total // window)
    assert sizes[total // window :] == [1 << b for b in reversed(range(8)) if total % window >> b & 1]
    # each window holds each source's share, of the sources that have not run out
    source = {r[0]: r[1] or "" for r in rows}
    left = Counter()
    for k, r in enumerate(rows):
        left[r[1] or ""] += len(ids[k])
    all_of = dict(left)
    named = {q: w for q, w in (targets or {}).items() if w > 0 and q in left}
    for k in range(total // window):
        found = Counter()
        for p in sequences[k]:
            found[source[p["doc_id"]]] += p["length"]
        weights = {q: w for q, w in named.items() if left[q]} or (dict(left) if targets else dict(all_of))
        scale = sum(weights.values())
        if all(left[q] >= 2 * window for q in weights) or not targets:
            assert all(abs(found[q] - window * w / scale) <= (quantum + 1) * (len(weights) + 1) for q, w in weights.items()), (k, found, weights)
        left -= found
