"""Queries without SQL against their plain versions, and shared readers and operators against brute force."""

import gzip
import hashlib
import io
import json
import random
import zipfile
from itertools import accumulate
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import plain_versions
from siltstone import registry
from siltstone.operators import judge
from siltstone.operators import relational as R
from siltstone.plans import mixture, ranking, retrieval, scans, udf_backed
from siltstone.sources import files

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(plain_versions.CHECKS))
def test_against_plain_version(spark, name):
    plain_versions.CHECKS[name](spark, FOLDER, registry.load()[name].run(spark, FOLDER).collect())


def test_prefix_and_first_wins(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), k * 7 - 500, r.randint(0, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {(x["g"], x["k"]): (x["before"], x["total"]) for x in R.prefix(df, ["g"], ["k"], R.by_value("k", 100), F.col("v"), "before", "total").collect()}
    for g in ("a", "b", None):
        own = sorted((k, v) for h, k, v in rows if h == g)
        sums = [0, *accumulate(v for _, v in own)]
        assert [got[(g, k)] for k, _ in own] == [(s, sums[-1]) for s in sums[:-1]]
    first = {x["g"]: x["k"] for x in R.first_wins(df, ["g"], ["v", "k"]).collect()}
    assert first == {g: min((v, k) for h, k, v in rows if h == g)[1] for g in ("a", "b", None)}


def test_sniffed_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(gzip.compress(b'{"k": 1, "s": "x"}\n\n{"k": 2, "s": "y"}\n'))
    (tmp_path / "b.gz").write_bytes(b'\xef\xbb\xbfk,s\n3,"a, b"\n4,\n')
    (tmp_path / "c.txt").write_text('[{"k": 5, "s": "\u00e9"}, {"k": 6}] {"k": 7}\n{"k": 8}')
    (tmp_path / "d.json").write_bytes(b"")
    got = {tuple(r) for r in files.sniffed(spark, str(tmp_path), "k long, s string").collect()}
    assert got == {(1, "x"), (2, "y"), (3, "a, b"), (4, ""), (5, "é"), (6, None), (7, None), (8, None)}


def test_objects_over_lines():
    assert list(files.values('{"a":\n 1}\n\n{"a": 2\n}\n', own_lines=True)) == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError, match="data after"):
        list(files.values('{"a": 1} x\n', own_lines=True))
    with pytest.raises(ValueError, match="incomplete"):
        list(files.values('{"a": 1}\n{"a":', own_lines=True))


def test_archives(spark):
    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, json.dumps({"id": n}))
        return bytearray(out.getvalue())

    df = spark.createDataFrame([("b", packed(["samples/2.json", "samples/1.json", "other.json"])), ("a", bytearray(b"no zip")), ("c", packed([]))], "path string, content binary")
    assert [(r["path"], r["name"]) for r in files.archived(df).collect()] == [("b", "samples/1.json"), ("b", "samples/2.json")]


def test_xml_walk():
    xml = '<document xmlns="u"><metadata>m</metadata><title>T</title><para>a <b>b</b>  c<note>n</note> d</para><list><item>x</item><item>y</item></list></document>'
    assert files.xml_plain(xml) == "T\n\na b c d\n\n- x\n\n- y"


def test_running_heads(spark):
    pages = [(k, "book", f"The  Title\nChapter {k}\nown words {k}\nmore\nwords\nin\nthe\nmiddle\nthe title\nPage {k}") for k in range(9)] + [(20, "other", "The Title\n7"), (21, "other", None)]
    got = {r["doc_id"]: r["body"] for r in scans.without_running_heads(spark.createDataFrame(pages, "doc_id long, source string, text string")).collect()}
    # the last four lines hold "middle" too, which stands on every page
    assert got[3] == "Chapter 3\nown words 3\nmore\nwords\nin\nthe" and got[20] == "The Title" and got[21] is None


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = sorted((r["n"], r["x"]) for r in files.numbered(spark, str(tmp_path), "x").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k * 5000 + i, f"{k}:{i}") for k in range(3) for i in range(5000)]


def test_receipt(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "out"))
    expected = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "out").glob("*.parquet")}
    assert {tuple(r) for r in files.receipt(spark, str(tmp_path / "out")).collect()} == expected


def test_signature_holds_the_options(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    manifest = files.signatures(spark, str(tmp_path / "in"), "v1")
    assert files.changed(spark, str(tmp_path / "in"), manifest, "v1").count() == 0
    assert files.changed(spark, str(tmp_path / "in"), manifest, "v2").count() == manifest.count()


def test_judge():
    class Flaky:
        def ask(self, key, prompt, attempt):
            if key == 1:
                raise ConnectionError("down")
            return ("[]", "stop") if key == 2 else ("{}", "length") if key == 3 else ('{"keep": true}', "stop") if attempt == 2 else ("{", "stop")

    got = [judge.one(Flaky(), k, "", 2, 0.0) for k in range(4)]
    assert [(s, n) for _, s, n, _, _ in got] == [("done", 2), ("error", 2), ("error", 2), ("error", 2)]
    assert "incomplete" in got[3][4] and "ConnectionError" in got[1][4]


def test_sqrt_allocation_with_a_factor():
    got = ranking.allocated({"a": 10000.0, "b": 10000.0}, 3000.0, {"b": 0.25})
    assert abs(got["b"] / got["a"] - 0.25) < 1e-9 and abs(sum(got.values()) - 3000) < 1e-6


def test_confusions():
    def brute(s, t, left=8):
        if not s and not t:
            return 0
        found = [brute(s[1:], t[1:], left)] if s and t and s[0] == t[0] else []
        found += [1 + x for a, b in udf_backed.CONFUSED if left and s.startswith(a) and t.startswith(b) for x in [brute(s[len(a) :], t[len(b) :], left - 1)] if x is not None]
        found = [x for x in found if x is not None]
        return min(found) if found else None

    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice("rnml1") for _ in range(r.randint(0, 9)))
        t = "".join(r.choice(["m", "rn", "1", "l", c]) if r.random() < 0.2 else c for c in s)
        assert udf_backed.confusions(s, t) == brute(s, t), (s, t)


def test_capped_selection(spark):
    r = random.Random(4)
    rows = [(k, r.randint(1, 60)) for k in range(300)]
    used, expected = 0, []
    for k, n in rows:
        if used + n <= 500:
            used += n
            expected.append(k)
    got = retrieval.capped(spark.createDataFrame(rows, "k long, n long"), ["k"], "n", 500, step=7)
    assert [x["k"] for x in got] == expected


def test_last_batch_is_kept():
    import numpy as np

    assert mixture.largest_batch(np.array([5, 5, 5]), 4, 8) is None


def test_context_overlap_finds_shared_histories(spark, tmp_path):
    import duckdb

    r = random.Random(8)
    histories = [[("user" if i % 2 == 0 else "assistant", r.choice("abc")) for i in range(6)] for _ in range(12)]
    rows = [(k, i, role, text) for k in range(60) for i, (role, text) in enumerate(r.choice(histories)[: r.randint(1, 6)])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    q = registry.load()["context_overlap"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(x) for x in q.run(spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(q.sql).fetchall()) and {x[2:] for x in got} >= {(True, True), (False, True)}
