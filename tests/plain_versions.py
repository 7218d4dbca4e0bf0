"""Queries that have no SQL: what their rows must be, computed plainly. Each check takes (spark, folder, rows of the query)."""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in table(spark, folder, "documents")}


def conversations(spark, folder):
    found = defaultdict(list)
    for r in sorted(table(spark, folder, "conversations"), key=lambda r: r["turn"]):
        found[r["conv_id"]].append((r["role"], r["text"]))
    return found


def sink_receipt(spark, folder, rows):
    assert rows and all(r["bytes"] > 0 and len(r["sha256"]) == 64 and r["name"].endswith(".parquet") for r in rows)


def unicode_normalize(spark, folder, rows):
    folded = {k: unicodedata.normalize("NFKC", x.replace("\r\n", "\n").replace("\r", "\n")).casefold() for k, x in texts(spark, folder).items()}
    assert {r["doc_id"]: r["normalized"] for r in rows} == folded


def edit_contract(spark, folder, rows):
    expected = defaultdict(int)
    for k, x in texts(spark, folder).items():
        target = x if k % 3 == 0 else x.replace("rn", "m") if k % 3 == 1 else x + "?"
        n = x.count("rn") if k % 3 == 1 else 0
        expected["undeclared" if k % 3 == 2 or n > 8 else "unchanged" if target == x else "accepted"] += 1
    assert {r["reason"]: r["rows_n"] for r in rows} == dict(expected)


def chunk_boundary(spark, folder, rows):
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["chunk"]):
        assert 0 < len(r["body"]) <= 1500 and r["body"] == r["body"].strip()
        own[r["doc_id"]].append(r["body"])
    for k, x in texts(spark, folder).items():
        assert "".join("".join(own[k]).split()) == "".join((x or "").split())
        # all but the last are at least half full, as a cut lies past the half or there is none before the limit
        assert all(len(body) > 700 or " " not in x[:1500] for body in own[k][:-1])


def chunk_pack(spark, folder, rows):
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["chunk"]):
        own[r["doc_id"]].append(r["body"].split("\n"))
    for k, x in texts(spark, folder).items():
        lines = [p for p in (x or "").split("\n") if p.strip()]
        met = []
        for i, piece in enumerate(own[k]):
            assert not i or piece[0] == met[-1]  # one paragraph of overlap
            assert len(piece) <= 2 or sum(map(len, piece[:-1])) <= 2000
            met += piece[1:] if i else piece
        assert met == lines


def speech_windows(spark, folder, rows):
    expected = set()
    for k, turns in conversations(spark, folder).items():
        pieces, held = [], []
        for _, x in turns:
            if held and sum(map(len, held)) + len(x) > 2000:
                pieces, held = [*pieces, "\n".join(held)], []
            held.append(x)
        pieces = [p for p in [*pieces, "\n".join(held)] if len(p) >= 200]
        expected |= {(k, i, p) for i, p in enumerate(pieces)}
    assert {tuple(r) for r in rows} == expected
    assert len(expected) == len(rows) and {k for k, _, _ in expected} != set(conversations(spark, folder))  # some have none


def suffix_anchor(spark, folder, rows):
    for r in rows:
        x = texts_of(spark, folder)[r["doc_id"]]
        line = x.split("\n")[0]
        sizes = [k for k in range(min(len(line), 256), 0, -8) if x.count(line[-k:]) * k == k]
        best = sizes[0] if sizes else None
        assert r["size"] == best and r["end"] == (x.index(line[-best:]) + 1 + best if best else None)


_TEXTS: dict = {}


def texts_of(spark, folder):
    if folder not in _TEXTS:
        _TEXTS[folder] = texts(spark, folder)
    return _TEXTS[folder]


def token_fit(spark, folder, rows):
    expected = set()
    for k, turns in conversations(spark, folder).items():
        words = [(role, x.split()) for role, x in turns]
        answers = [i for i, (role, _) in enumerate(words) if role == "assistant"]
        if not answers or len(words[answers[-1]][1]) < 2:
            continue
        last = answers[-1]
        first = next(i for i in range(last + 1) if i == last or sum(len(w) + 1 for _, w in words[i : last + 1]) <= 512)
        prompt = sum(len(w) + 1 for _, w in words[first:last]) + 1
        expected.add((k, first, prompt, prompt + len(words[last][1])))
    assert {tuple(r) for r in rows} == expected


def multipack(spark, folder, rows):
    sizes = {r["doc_id"]: min(8192, max(1, r["n_chars"] // 4)) for r in table(spark, folder, "documents")}
    assert sorted(r["doc_id"] for r in rows) == sorted(sizes)  # every row once, the last batch's too
    bins, batches = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["n"] == sizes[r["doc_id"]] and 0 <= r["bin"] < 4 and r["shard"] == r["doc_id"] // 4096
        bins[(r["shard"], r["batch"], r["bin"])] += r["n"]
        batches[(r["shard"], r["batch"])].append(r["doc_id"])
    assert max(bins.values()) <= 8192
    ranges = sorted((min(ids), max(ids)) for ids in batches.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))  # batches are runs of rows


def bootstrap_ci(spark, folder, rows):
    found = defaultdict(list)
    for r in table(spark, folder, "events"):
        found[r["event_type"]].append(r["value"])
    assert {r["event_type"] for r in rows} == set(found)
    for r in rows:
        v = np.array(found[r["event_type"]])
        error = v.std(ddof=1) / len(v) ** 0.5
        assert abs(r["mean"] - v.mean()) < error and 0.7 < (r["high"] - r["low"]) / (2 * 1.96 * error) < 1.3


def block_bootstrap(spark, folder, rows):
    days = defaultdict(lambda: defaultdict(list))
    for r in table(spark, folder, "events"):
        days[r["event_type"]][r["ts"].date()].append(r["value"])
    assert {r["event_type"] for r in rows} == set(days)
    for r in rows:
        v = np.array([np.mean(x) for _, x in sorted(days[r["event_type"]].items())])
        rng, block = np.random.default_rng(7), min(5, len(v))
        starts = rng.integers(0, len(v), (1000, -(-len(v) // block)))
        draws = [np.concatenate([np.take(v, range(s, s + block), mode="wrap") for s in row])[: len(v)].mean() for row in starts]
        assert np.allclose([r["mean"], r["low"], r["high"]], [v.mean(), *np.quantile(draws, [0.025, 0.975])])


CHECKS = {
    f.__name__: f
    for f in (sink_receipt, unicode_normalize, edit_contract, chunk_boundary, chunk_pack, speech_windows, suffix_anchor, token_fit, multipack, bootstrap_ci, block_bootstrap)
}
