"""char_tfidf_rank against its SQL on odd rows and on every path, and on a long text."""

import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone import registry
from siltstone.operators import grams

QUERY = registry.load()["char_tfidf_rank"]
WORDS = "alpha beta gamma delta été straße 東京都庁 😀😁 zero\0byte one two three".split(" ")


def rows(seed: int, count: int, words: int) -> list[str]:
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(WORDS, r.integers(2, words))) for _ in range(count)]


def tables(spark, folder, documents, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(c.execute(QUERY.sql).fetchall(), key=repr)


def ranked(spark, folder):
    return sorted(map(tuple, QUERY.run(spark, str(folder)).select("item_id", "doc_id", "rank").collect()), key=repr)


@pytest.mark.parametrize("sent, items", [(10**6, 2048), (10**6, 3), (40, 2048)])
@pytest.mark.parametrize("odd", [False, True])
def test_same_ranks_as_sql(spark, tmp_path, monkeypatch, sent, items, odd):
    """Few runs sent: the others are joined, and items take several passes; few items: several blocks."""
    monkeypatch.setattr(grams, "SENT", sent)
    monkeypatch.setattr(grams, "ITEMS", items)
    documents, benchmark = list(enumerate(rows(1, 60, 20))), list(enumerate(rows(2, 9, 6)))
    documents += [(60 + i, documents[i][1]) for i in range(5)] + [(70, None), (71, ""), (72, "abc"), (73, "beta"), (None, "alpha beta rare")]
    if odd:  # ids that several rows share
        documents += [(None, "gamma delta unseen"), (3, "alpha one two"), (3, "three été"), (4, None)]
        benchmark += [(None, "gamma delta"), (2, "alpha beta"), (50, None), (51, "xyz"), (52, "nowhere")]
    want = tables(spark, tmp_path, documents, benchmark)
    assert len(want) > 20
    assert ranked(spark, tmp_path) == want


def test_no_run_anywhere(spark, tmp_path):
    assert tables(spark, tmp_path, [(1, "abc"), (2, None)], [(1, "abcd")]) == []
    assert ranked(spark, tmp_path) == []


@pytest.mark.parametrize("characters", [3, 300, 40_000])
def test_runs_by_brute_force(characters):
    """Many different characters make the runs too wide for one number; their pairs are numbered then."""
    r = np.random.default_rng(characters)
    letters = [chr(x) for x in r.choice([x for x in range(0x20000) if not 0xD800 <= x < 0xE000], characters, replace=False)]
    held = ["".join(r.choice(letters, n)) for n in (4, 5, 90_000, 7)]
    a, b, first, text, times = grams.counted(held)
    spelt = ["".join(chr(x) for h in (x, y) for x in (h >> grams.POINT, h & ((1 << grams.POINT) - 1))) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(set(spelt)) == len(spelt)
    found = Counter({(int(text[i]), g): int(times[i]) for g, low, high in zip(spelt, first[:-1], first[1:], strict=True) for i in range(low, high)})
    assert found == Counter((i, x[j : j + 4]) for i, x in enumerate(held) for j in range(len(x) - 3))
    places = grams.Places(a[::2], b[::2])
    at = places.of(a, b)
    assert (at[::2] == np.arange(len(a[::2]))).all() and (at[1::2] == -1).all()


def test_products_in_parts(monkeypatch):
    held = rows(5, 30, 12)
    a, b, first, text, times = counts = grams.counted(held)
    start = np.arange(0, 2 * len(a) + 1, 2)
    block = (["x", "y"], grams.Places(a, b), np.ones(len(a)), start, np.tile([0, 1], len(a)), np.tile([1.0, 3.0], len(a)))
    whole = grams._products(block, *counts, len(held))
    monkeypatch.setattr(grams, "PRODUCTS", 7)
    assert np.array_equal(grams._products(block, *counts, len(held)), whole)
    assert whole[0].tolist() == [len(x) - 3 for x in held] and (whole[1] == 3 * whole[0]).all()


def test_time_follows_the_length_of_a_text(spark, tmp_path):
    """Each run was cut out from the start of its text, so a long text took the square of its length."""
    r = np.random.default_rng(7)
    long = "é" + "".join(r.choice(list("abcdefgh "), 1_000_000))
    spark.createDataFrame([(1, long), (2, "abcd efgh")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "abcd efgh")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    began = time.time()
    assert ranked(spark, tmp_path) == [(1, 1, 2), (1, 2, 1)]
    assert time.time() - began < 60
