"""Each stage of the pipeline against a plain version of it, on the smallest tables."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import linededup
from siltstone.llm.simhash import fingerprint
from siltstone.llm.tokens import TOKENIZER
from siltstone.session import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


def plain_language(docs):
    return {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}


def plain_lines(docs):
    lines = [(i, k, x) for i in sorted(docs) for k, x in enumerate(docs[i].split("\n")) if re.search(r"\S", x)]
    seen, group = {}, {}
    root = {x: x for _, _, x in lines}
    for x in root:
        if x.count(" ") >= 9 or len(x) >= 40:  # shorter lines join equal ones alone
            seen.setdefault(len(x), set()).add(x)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, own in seen.items():
        for x in own:
            for y in (y for m in (n, n + 1, n + 2) for y in seen.get(m, ())):
                if x != y and linededup.within(x, y, 2):
                    root[find(y)] = find(x)
    gone = set()
    for i, k, x in lines:
        if group.setdefault(find(x), (i, k)) != (i, k):
            gone.add((i, k))
    out = {}
    for i, t in docs.items():
        rest = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if len(rest) == t.count("\n") + 1 or re.search(r"\S", "\n".join(rest)):
            out[i] = "\n".join(rest)
    return out


def plain_copies(docs):
    fps = {i: fingerprint(t.encode()) for i, t in docs.items()}
    least = {i: i for i in fps}
    for _ in range(5):
        for i in fps:
            least[i] = min(least[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
    return {i: t for i, t in docs.items() if least[i] == i}


def plain_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {tuple(w[k : k + 13]) for w in map(words, items) for k in range(len(w) - 12)}
    return {i: t for i, t in docs.items() if not any(tuple(w[k : k + 13]) in runs for w in [words(t)] for k in range(len(w) - 12))}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = [plain_language, plain_lines, plain_copies, lambda d: plain_leaks(d, items)]
    for (name, stage), reference in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == reference(before), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    tokens = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    held: dict[int, int] = {}
    for p in pieces:
        held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["length"]
    assert held == tokens


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, ids that are shared or missing, clashing names, and no rows at all."""
    leak = "Tom had 3 apples and 5 pears in his basket when the farmer asked him to share them all with Anna"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = "the river and the old mill near a town that nobody knows by name".split()
    text = lambda k: " ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] + str(k) * (i % 9 == 0) for i in range(40))
    rows = [(k, text(k), "en") for k in range(40)] + [(50, None, "en"), (51, "", "en"), (52, "12 34", None), (None, text(60), "en"), (None, text(61), None), (53, text(62), None), (53, text(62), None), (53, text(63), "en"), (54, leak.replace("3", "9"), "en"), (None, leak, "en")]
    names = "lang_pred string, score double, id__ long, row__ long, gone__ string, fingerprint string, component_id long, windows long, w long, part int, uid long, ids binary, q string, start long"
    odd = spark.createDataFrame([(i, t, lang, "s", 3, "x", 1.0, 2, 3, "y", "z", 4, 5, 6, 7, 8, bytearray(b"i"), "q", 9) for i, t, lang in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns, name
    texts = [r["text"] for r in docs.collect()]
    assert leak not in texts and leak.replace("3", "9") not in texts and None not in texts and "12 34" not in texts
    assert text(60) in texts and text(61) in texts and texts.count(text(62)) <= 1 and {text(k) for k in range(0, 40, 5)} & set(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.count() >= docs.count()
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
