"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats, no rows and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from siltstone.llm import chat, decontam, langid, linededup, rans, secrets, simhash, toxicity, voronoi
from siltstone.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base + " omega"), (4, None), (5, ""), (6, prose(2, 3)), (7, "A\tB\x0bc"), (8, prose(3, 9000)), (9, prose(3, 9000)), (10, "   "), (11, prose(4, 60)), (11, prose(4, 60)), (None, prose(5, 50)), (13, "Größe é漢字 😀 x")]
    rows += [(20 + k, prose(100 + k, 40)) for k in range(30)]
    return spark.createDataFrame([(i, t, "en", "s%d" % ((i or 0) % 3) if i != 7 else None, 7, "x", "y", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, line string, score double").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def reference_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs):
    got = simhash.simhash_groups(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    fps = [(r["doc_id"], reference_fingerprint(r["text"])) for r in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((fps[k][0] for k in range(len(fps)) if group[k] == g and fps[k][0] is not None), default=None) for g in set(group)}
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", least[g]) for (i, f), g in zip(fps, group, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert 2 not in [r["doc_id"] for r in kept.collect()]
    assert simhash.simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_simhash_crowded_key(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(3)
    fps = {r.getrandbits(20) for _ in range(400)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    roots = {x["node"]: x["root"] for x in components(spark.createDataFrame([(x["a"], x["b"]) for x in links], "a long, b long")).collect()}
    order = sorted(fps)
    label = dict(zip(order, order, strict=True))
    changed = True
    while changed:
        changed = False
        for a in order:
            m = min(label[b] for b in order if (a ^ b).bit_count() <= 3)
            if m < label[a]:
                label[a], changed = m, True
    assert {f: roots.get(f, f) for f in order} == label


def test_components(spark):
    r = random.Random(5)
    ids = r.sample(range(1 << 40), 200)
    edges = [(ids[k], ids[k + 1]) for k in range(99)] + [(ids[100], ids[k]) for k in range(101, 150)] + [(ids[5], ids[5]), (None, ids[7])]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(ids[:100]) for i in ids[:100]} | {i: min(ids[100:150]) for i in ids[100:150]}


def test_rans_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 1023, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
        coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=3001)))
        block = rans.pack_block(coder, 3, 17, [5, None], np.array([n - 1, 1]), ids)
        part, start, docs, lengths, back = rans.unpack_block(coder, block)
        assert (part, start, docs, lengths.tolist(), back.tolist()) == (3, 17, [5, None], [n - 1, 1], ids.tolist())
        spoilt = bytearray(block)
        spoilt[-1] ^= 1
        with pytest.raises(ValueError):
            rans.unpack_block(coder, bytes(spoilt))
    assert rans.scaled(np.array([10**9, 1, 0, 1])).sum() == 1 << rans.SCALE_BITS


def test_line_distance_and_keys():
    r = random.Random(2)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "b", "c"])
        b = "".join(b)
        true = linededup._plain(a, b)
        for edits in (1, 2, 3):
            assert linededup.within(a, b, edits) == (true <= edits)
            if true <= edits < min(len(a), len(b)):
                owner, keys = linededup.keys_of([a, b], edits)
                assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_line_dedup(spark, docs):
    line = prose(50, 30)
    many = [(100 + k, f"first {k}\n{line[:40]}{k:02d}{line[40:]}\n") for k in range(60)]  # one key, two edits apart at most
    extra = spark.createDataFrame([(i, t, "en", "s", 3, "x", "y", 1.0) for i, t in many], docs.schema)
    rows = linededup.line_dedup(docs.unionByName(extra)).collect()
    gone = {(r["doc_id"], r["line_no"]) for r in rows if not r["keep"]}
    assert {(k, 1) for k in range(101, 160)} <= gone and (100, 1) not in gone
    assert (2, 0) in gone and (1, 0) not in gone and (4, 0) not in gone
    kept = linededup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and 2 not in [r["doc_id"] for r in kept.collect()]
    assert linededup.line_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("sampled,few", [(linededup.SAMPLED, linededup.FEW), (1, 2)])
def test_line_classes_against_brute_force(spark, monkeypatch, sampled, few):
    """Chains of edited lines, many of which share a segment; with small bounds every way of the join is taken."""
    monkeypatch.setattr(linededup, "SAMPLED", sampled)
    monkeypatch.setattr(linededup, "FEW", few)
    r = random.Random(21)
    lines = []
    for k in range(12):
        x = "".join(r.choice("abcdefgh ") for _ in range(r.randint(40, 60)))
        for _ in range(15):
            lines.append(x)
            y = list(x)
            for _ in range(r.randint(0, 3)):
                y[r.randrange(20, len(y))] = r.choice("xyz")  # the first segment stays the same
            x = "".join(y) if r.random() < 0.8 else x[:-1]
    lines += ["q" * 40 + f" {k:04d} " + "".join(r.choice("abcdefgh") for _ in range(20)) for k in range(150)]
    lines = [x for x in dict.fromkeys(lines) if x.strip() and len(x) >= 40]
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if abs(len(x) - len(y)) <= 2 and linededup._plain(x, y) <= 2:
                root[find(x)] = find(y)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got, expected = {}, {}
    for row in linededup.line_dedup(docs).collect():
        got.setdefault(row["class_id"], set()).add(row["doc_id"])
    for i, x in enumerate(lines):
        expected.setdefault(find(x), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and len(expected) < len(lines)


def test_line_dedup_of_short_and_unspaced_lines(spark):
    notice, han = "All rights reserved.", "漢字" * 30
    near = han[:20] + "々" + han[21:]
    rows = [(1, f"{notice}\n\n{han}\n  "), (2, f"own\n\n{notice}"), (3, f"{near}\n{notice}\n  "), (4, "own two\nown"), (5, "All rights reserved!")]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 13
    assert {(r["doc_id"], r["line_no"]) for r in got if not r["keep"]} == {(2, 2), (3, 0), (3, 1), (4, 1)}


def test_what_is_left_of_a_document_stays(spark):
    shared, other = prose(60, 200), prose(61, 200)
    rows = [(1, shared), (2, f"{shared}\nonly here\n{other}"), (3, f"{other}\n{shared}\nits own words"), (4, f"{shared}\n\n \t\u00a0"), (5, " \n"), (6, f"{shared}\n{shared}")]
    kept = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: shared, 2: f"only here\n{other}", 3: "its own words", 5: " \n"}


def test_line_dedup_of_repeated_and_null_ids(spark):
    a, b = prose(70, 20), prose(71, 20)
    rows = [(1, f"{a}\none", 0), (1, f"two\n{b}", 1), (1, f"two\n{b}", 2), (2, f"{b}\nthree", 3), (None, f"{a}\nfour", 4), (None, f"five\n{a}", 5), (None, None, 6), (3, "", 7), (3, "", 8)]
    names = "id__ long, row__ string, GONE__ long, text__ long, __gone long, __text string"
    docs = spark.createDataFrame([(*x, 0, "r", 0, 0, 0, "t") for x in rows], f"doc_id long, text string, place long, {names}")
    kept = linededup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    got = [(r["place"], r["text"]) for r in kept.collect()]
    # of the null rows the text with the smaller hash comes first and keeps the shared line
    assert {x for x in got if x[0] in (0, 3, 6)} == {(0, "one"), (3, "three"), (6, None)}
    assert [x[1] for x in got if x[0] in (1, 2)] == [f"two\n{b}"] and len([x for x in got if x[0] in (7, 8)]) == 1
    assert sorted(x for x in got if x[0] in (4, 5)) in ([(4, f"{a}\nfour"), (5, "five")], [(4, "four"), (5, f"five\n{a}")])
    lines = linededup.line_dedup(docs).collect()
    assert len(lines) == 14 and all(r["keep"] for r in lines if r["class_id"] not in {x["class_id"] for x in lines if not x["keep"]})


def test_decontamination(spark, docs):
    item = "A train leaves Paris at 7 km and 30 minutes before the other train that Anna takes to reach the small town by the river"
    other = "A train leaves Paris at 9 km and 45 minutes before the other train that Maria takes to reach the small town by the river"
    twice = "Tom had 3 apples and 3 pears in his basket"
    benchmark = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "too short", "z"), (4, twice, "z")], "item_id long, text string, doc_id string")
    # a value of the item that is two values in the document is no instance; two values that become one are
    clash, joined = twice.replace("3 apples", "4 apples").replace("3 pears", "5 pears"), item.replace("30 minutes", "7 minutes")
    extra = spark.createDataFrame([(i, t, "en", "s", 3, "x", "y", 1.0) for i, t in ((200, "so then. " + item + " and on"), (201, other), (202, clash), (203, joined), (204, twice.replace("3", "8")))], docs.schema)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs.unionByName(extra), benchmark).collect()}
    assert got == {(200, 1), (201, 1), (203, 1), (204, 4)}
    assert decontam.keep_clean(docs.unionByName(extra), benchmark).columns == docs.columns
    assert decontam.matches(empty(spark), benchmark).count() == 0
    assert decontam.matches(docs, benchmark.limit(0)).count() == 0


def test_decontamination_counts_windows_beside_a_clash(spark):
    item = "Each of the 3 boys who live near the old mill buys as many apples as he can carry home while each of the 3 girls sells all of the pears that her mother picked on that day"
    twin = "Tom had 3 apples and 5 pears in his basket when the farmer asked him to share them"
    benchmark = spark.createDataFrame([(1, item), (2, twin)], "item_id long, text string")
    rows = [(1, item.replace("3 girls", "4 girls")), (2, twin.replace("3", "4").replace("5", "4")), (3, "of the 3 boys and each of the 4 girls who live near the sea")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 1), (2, 2)}


def test_decontamination_of_short_and_number_heavy_items(spark):
    sums = "12 + 7 = 19, 30 - 4 = 26, 15 + 8 = 23, 9 + 5 = 14, 40 - 6 = 34"
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, sums), (3, "法国的首都是哪里"), (4, "...")], "item_id long, text string")
    rows = [(1, "so, What is the Capital of france? it asks"), (2, f"solve {sums} now"), (3, "问：法国的首都是哪里？"), (4, "What is the capital of Spain?"), (5, sums.replace("19", "18").replace("26", "25").replace("23", "22").replace("14", "13")), (6, None), (7, "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_decontamination_of_repeated_and_null_ids(spark):
    item = "Tom had 3 apples and 5 pears in his basket when the farmer asked him to share them all with Anna"
    leak, clash = item.replace("3", "8").replace("5", "9"), "Tom had 3 apples and 3 pears in his basket"
    benchmark = spark.createDataFrame([(1, item), (2, clash)], "item_id long, text string")
    other = clash.replace("3 apples", "4 apples")
    rows = [(1, leak, 0), (1, "Tom had 7 apples and 2 pears and then some more words that say nothing", 1), (None, leak, 2), (None, other, 3), (None, None, 4), (2, other, 5), (2, other, 6), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, benchmark).collect()} == {(1, 1), (None, 1)}
    assert {r["row"] for r in decontam.keep_clean(docs, benchmark).collect()} == {1, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("sent,shared", [(decontam.SENT, decontam.SHARED), (0, 1), (decontam.SENT, 1)])
def test_decontamination_against_brute_force(spark, monkeypatch, sent, shared):
    """Short items of plain words and numbers, whose windows and clashes can be counted by hand; also by the shuffled join, and with shared windows looked up late."""
    monkeypatch.setattr(decontam, "SENT", sent)
    monkeypatch.setattr(decontam, "SHARED", shared)
    r = random.Random(12)
    words = ["ox", "elk", "cow", "hen"]

    def text(n):
        return " ".join(str(r.randint(1, 3)) if r.random() < 0.3 else r.choice(words) for _ in range(n))

    items = [(k, text(r.randint(8, 14))) for k in range(25)]
    items += [(30 + k, "the same words open each of these many items " + text(8)) for k in range(6)]
    docs = []
    for k in range(60):
        x = r.choice(items)[1].split()
        x = [str(int(w) % 3 + 1) if w.isdigit() and r.random() < 0.4 else w for w in x]
        docs.append((k, " ".join(["so"] * r.randint(0, 3) + x + text(r.randint(0, 6)).split())))

    def windows(w):
        return range(max(0, len(w) - 7))

    def is_match(item, doc):
        slot = lambda w: w.isdigit()
        plain = lambda w: ["#" if slot(x) else x for x in w]
        few = [i for i in windows(item) if sum(map(slot, item[i : i + 8])) <= 4]
        many = [i for i in windows(item) if i not in few]
        hits = {(j - i, i) for i in few for j in windows(doc) if plain(item[i : i + 8]) == plain(doc[j : j + 8])}
        good = set()
        for d in {d for d, _ in hits}:
            own = [i for e, i in hits if e == d]
            found = {}
            for i in own:
                for a, b in zip(item[i : i + 8], doc[i + d : i + d + 8], strict=True):
                    if slot(a):
                        found.setdefault(a, set()).add(b)
            bad = {a for a, b in found.items() if len(b) > 1}
            good |= {i for i in own if item[i : i + 8] == doc[i + d : i + d + 8] or not bad & set(item[i : i + 8])}
        heavy = {i for i in many for j in windows(doc) if item[i : i + 8] == doc[j : j + 8]}
        return (few and len(good) >= min(6, len(few))) or len(good | heavy) >= min(6, len(few) + len(many))

    expected = {(k, i) for k, d in docs for i, x in items if is_match(x.split(), d.split())}
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(expected) > 30


def test_language(spark):
    sets = {"aa": "la lo le li lu ra ro", "bb": "zik zak zok tik tak", "cc": "mum nun mim non"}
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(sets[lang].split()) for _ in range(20)), lang) for k, lang in enumerate(sorted(sets) * 60)]
    rows += [(900, None, "aa"), (901, "12 34", "bb"), (902, "", None), (903, "la lo " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}
    assert all(got[k]["lang_pred"] == lang for k, t, lang in rows[:180])
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify(df.limit(0)).count() == 0
    clash = df.withColumn("score", df.doc_id).withColumn("lang_pred", df.lang).withColumn("__text", df.lang).withColumn("Lang_Pred_", df.lang).withColumn("text_", df.lang)
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns and {x["doc_id"] for x in kept.collect()} == {*range(180), 903}


def test_held_out_languages_and_other_columns_change_nothing(spark):
    sets = {"aa": "la lo le li lu ra ro", "bb": "zik zak zok tik tak", "cc": "mum nun mim non"}
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(sets[lang].split()) for _ in range(20)), lang, "s") for k, lang in enumerate(sorted(sets) * 30)]
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    told = lambda rows: sorted(map(tuple, langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()))
    first = told(rows)
    assert first == told([(k, t, "cc" if out(k) else lang, f"other{k}") for k, t, lang, _ in rows])
    assert {x[0] for x in first if x[1]} == {k for k in range(90) if out(k)}


def test_every_language_is_learnt(spark):
    r = random.Random(5)
    names = [f"l{k:03d}" for k in range(100)]
    words = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for n in names}
    rows = [(k, " ".join(r.choice(words[n]) for _ in range(40)), n) for k, n in enumerate(names * 6)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100).collect()
    assert len({x["lang_pred"] for x in got}) == 100
    assert sum(x["lang_pred"] == rows[x["doc_id"]][2] for x in got) >= 590
    assert langid.bits_for(4) == 15 and langid.bits_for(1000) == 12 and langid.bits_for(10**6) == langid.LEAST_BITS


def test_counts_are_not_clipped():
    found = langid.counts("ab" * 200_000)
    assert found.max() > 199_000 and langid.counts("ab" * 200_000, 10).sum() == found.sum()


def test_segments_are_maximal():
    r = random.Random(6)
    for _ in range(300):
        hits = [(k, round(r.uniform(0.1, 1.5), 2)) for k in range(40) if r.random() < 0.3]
        got = toxicity.segments(hits)
        score = [dict(hits).get(k, -toxicity.COST) for k in range(40)]

        def best(lo, hi):
            """The recursive definition: the best segment, then left and right of it."""
            found = max(((sum(score[a : b + 1]), -(b - a), a, b) for a in range(lo, hi) for b in range(a, hi)), default=None)
            if not found or found[0] <= 1e-12:
                return []
            _, _, a, b = found
            return best(lo, a) + [(a, b)] + best(b + 1, hi)

        assert [round(sum(score[a : b + 1]), 6) for a, b in best(0, 40)] == [round(t, 6) for _, _, t in got]


def test_toxicity(spark):
    r = random.Random(8)
    rows = [(k, " ".join((r.choice(["nasty", "vile"]) if k % 3 == 0 and r.random() < 0.2 else r.choice(WORDS)) for _ in range(60)), int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([(k, t, k) for k, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k]["predicted"] == y for k, t, y in rows if y == ("nasty" in t or "vile" in t))
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {x["predicted"] for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def toxic_rows(n=400):
    r = random.Random(18)
    texts = [" ".join((r.choice(["nasty", "vile", "foul"]) if k % 4 == 0 and r.random() < 0.25 else r.choice(WORDS)) for _ in range(r.randint(20, 90))) for k in range(n)]
    return [(k, t) for k, t in enumerate(texts)], [(k, int(k % 4 == 0) if k % 29 else 1 - int(k % 4 == 0)) for k in range(n)]


def test_held_out_labels_change_no_score(spark):
    rows, labels = toxic_rows()
    out = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda x: sorted((r["doc_id"], r["held_out"], r["score"]) for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
    first = run(labels)
    assert {k for k, h, _ in first if h} == {k for k, _ in rows if out(k)}
    assert first == run([(k, 1 - y if out(k) else y) for k, y in labels]) == run([x for x in labels if not out(x[0])])


def test_toxicity_against_plain_version(spark):
    rows, labels = toxic_rows()
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    known = {r["doc_id"]: (r["y"], r["fold"]) for r in toxicity.labelled(docs, given, 10**6).collect()}
    texts = {k: t.split() for k, t in rows}

    def scores(folds):
        toxic, clean = Counter(), Counter()
        for k, (y, f) in known.items():
            if f in folds:
                for w in set(texts[k]):
                    toxic[w] += y
                    clean[w] += 1 - y
        t_all, c_all, found, share = sum(toxic.values()), sum(clean.values()), {}, {}
        for w in toxic.keys() | clean.keys():
            prior = toxicity.EVEN + toxicity.STRENGTH * (toxic[w] + clean[w]) / (t_all + c_all)
            t, c = toxic[w] + prior, clean[w] + prior
            low = np.log(t / (t_all + toxicity.STRENGTH)) - np.log(c / (c_all + toxicity.STRENGTH)) - toxicity.DOUBT * np.sqrt(1 / t + 1 / c)
            if low > 0:
                found[w], share[w] = low, c / c_all
        lo, hi, rest = 1e-6, 50.0, max(0.0, 1 - sum(share.values()))
        for _ in range(100):
            mid = (lo + hi) / 2
            over = sum(share[w] * np.exp(min(700.0, mid * found[w])) for w in found) + rest * np.exp(-mid * toxicity.COST) > 1
            lo, hi = (lo, mid) if found and over else (mid, hi)
        return found, min(hi, 5.0)

    def totals(words, own):
        return [t for _, _, t in toxicity.segments([(k, own[w]) for k, w in enumerate(words) if w in own])]

    own, rate = scores(set(range(toxicity.FOLDS)))
    apart = {k: totals(texts[k], scores(set(range(toxicity.FOLDS)) - {f})[0]) for k, (_, f) in known.items()}
    clean = np.mean([rate * max(apart[k], default=0.0) - np.log(len(texts[k])) for k, (y, _) in known.items() if y < 0.5])
    scale = np.exp(clean - 0.5772156649)

    def evidence(found, n):
        surprise = [rate * t - np.log(scale * n) for t in found]
        return sum(s for s in surprise if s >= -np.log(toxicity.SIGNIFICANT))

    slope, base = toxicity.logistic(np.log1p([evidence(apart[k], len(texts[k])) for k in known]), np.array([y for y, _ in known.values()]))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, given).collect()}
    expected = {k: 1 / (1 + np.exp(-(base + slope * np.log1p(evidence(totals(w, own), len(w)))))) for k, w in texts.items()}
    assert max(abs(got[k] - expected[k]) for k in expected) < 1e-6 and len({round(x, 3) for x in got.values()}) > 20


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).round(3).tolist()) for k in range(300)] + [(400 + k, [0.5] * 8) for k in range(120)]
    rows += [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, [9.0] * 4), (650, [0.25] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(256 * np.array((v + [0.0] * 9)[:9])).astype(int) for i, v in rows if i not in (700, 701, 702, 703)}
    expected = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-(int(whole[q] @ x)), i) for i, x in whole.items() if i != q)[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in voronoi.top_k(df, pivots=8).collect()} == expected
    assert voronoi.top_k(df.limit(0)).count() == 0
    assert voronoi.top_k(spark.createDataFrame([(50, [1.0]), (3, [2.0])], df.schema)).collect() == [(50, 1, 3, 131072)]


def test_top_k_of_repeated_ids(spark, caplog):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).round(2).tolist()) for k in range(1, 400)]
    rows += [(100, rows[99][1])] * 9 + [(50, rows[49][1])] * 7 + [(7, rng.normal(size=6).tolist()) for _ in range(5)]
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=12).collect()
    for q in range(50, 400, 50):
        vector = next(v for i, v in whole if i == q)
        best = sorted((-int(vector @ x), i) for i, x in whole if i != q)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in best]


def test_groups_out_of_reach_are_not_searched(spark, caplog):
    rng = np.random.default_rng(6)
    rows = [(k, (np.eye(8)[k % 8] * 50 + rng.normal(size=8)).tolist()) for k in range(2000)]
    with caplog.at_level("INFO", logger=voronoi.__name__):
        got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=16).collect()
    kept, pairs = (int(x) for x in __import__("re").findall(r"\d+", caplog.records[-1].getMessage())[:2])
    assert len(got) == 200 and kept < pairs / 3


def test_chat_orders_ties_by_role_and_text(spark):
    r = random.Random(7)
    rows, expected = [], {}
    for k in range(20):
        turns = [(t, r.choice(["user", "assistant"]), f"{k} {t} {j} {r.random()}") for t in range(4) for j in range(3)]
        rows += [(2 * k, *x) for x in turns] + [(2 * k + 1, *x) for x in turns if x[0] < 3]
        expected[2 * k] = [x[2] for x in sorted(turns)]
        # a snapshot cut inside the tied turns is a prefix only in the order of role and text
        rows += [(1000 + k, *x) for x in sorted(turns)[:8]]
    r.shuffle(rows)
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x["conv_id"]: [y.split("\n")[1] for y in x["rendered"].split("\n<|end|>\n")[:-1]] for x in got} == expected


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (4, None, "system", "<|x|>"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "a")]
    rows += [(6, k, "user", str(k)) for k in range(600)] + [(7, k, "user", str(k)) for k in range(590)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kept = {r["conv_id"]: (r["turns"], r["copies"]) for r in got}
    assert kept == {1: (2, 2), 4: (2, 1), 6: (600, 1)}
    assert [len(r["rendered"].split("<|end|>\n")) - 1 for r in sorted(got, key=lambda r: r["part"]) if r["conv_id"] == 6] == [256, 256, 88]
    assert next(r["rendered"] for r in got if r["conv_id"] == 4) == "<|system|>\n< |x| >\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_secrets(spark):
    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    rows = [(1, f'so token = "{key}" ends'), (2, f"commit {key} fixes it"), (3, None), (4, ""), (5, "file https://www.example.org/index2/config/main.py here"), (6, f'token = "{key}" and again token = "{key}" ' + "w " * 20000), (1, "plain")]
    got = secrets.scan(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, candidate string")).collect()
    assert {(r["doc_id"], r["is_secret"], r["occurrences"]) for r in got if r["candidate"] == key} == {(1, True, 1), (2, False, 1), (6, True, 2)}
    assert not any(r["is_secret"] for r in got if r["doc_id"] == 5)


def test_every_place_of_a_secret_counts(spark):
    key = "f33e9a0c51d24b7786aa10c2d4e5f6a7"
    rows = [(1, f"commit {key} is in. password = \"{key}\""), (2, 'password = "hunter2!x" then'), (3, "secret: 'p@ss#W0rd!2024xyz'"), (4, "token = 'qzkvmwtrplhgzxqkvbnwtrml'"), (5, f"export API_KEY={key}"), (6, "the password: required here"), (7, "Donaudampfschifffahrtsgesellschaft faehrt"), (None, f"access_token={key}"), (None, "clean")]
    docs = spark.createDataFrame([(*x, "a", "b", "c", "d") for x in rows], "doc_id long, text string, id__ string, row__ string, secrets__ string, __secrets string")
    got = {(r["doc_id"], r["candidate"]): r for r in secrets.scan(docs).collect()}
    assert got[(1, key)]["is_secret"] and got[(1, key)]["occurrences"] == 2 and got[(1, key)]["position"] == rows[0][1].rindex(key) + 1
    for i, c in ((2, "hunter2!x"), (3, "p@ss#W0rd!2024xyz"), (4, "qzkvmwtrplhgzxqkvbnwtrml"), (5, key), (None, key)):
        assert (i, c) in got and got[(i, c)]["is_secret"], (i, c)
        assert got[(i, c)]["position"] == next(t for k, t in rows if k == i).index(c) + 1
    assert not any(r["is_secret"] for (i, _), r in got.items() if i in (6, 7))
    redacted = secrets.redact(docs)
    assert redacted.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in redacted.collect()) == sorted((i or 0, t.replace(key, "[SECRET]").replace("hunter2!x", "[SECRET]").replace("p@ss#W0rd!2024xyz", "[SECRET]").replace("qzkvmwtrplhgzxqkvbnwtrml", "[SECRET]")) for i, t in rows)
    assert secrets.scan(docs.limit(0)).count() == 0 and secrets.redact(docs.limit(0)).count() == 0


def test_candidates_against_a_plain_scan(spark):
    import re

    r = random.Random(11)
    bits = ["word ", "a" * 15, "Ab1" * 6, "token='x!y?z9w'", "key = ", " ", "\n", ".", "=", "/usr/lib/x86_64/", "QQQQQQQQQQQQQQQQQ", "é", "password: ", "\"", "abc123" * 4]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(200)] + ["Ab1" * 6 + " "] * 1 + [" ".join(f"id{k:020d}" for k in range(400))]
    names = r"(?:[Pp]assw|pwd|secret|token|api[_-]?key|credential|auth)"

    def plain(text):
        out, at = [], 0
        while at < len(text):
            head = text[:at]
            m = re.match(r"[^\s\"'`<>]{6,}", text[at:])
            if m and re.search(names + r"[A-Za-z0-9_]{0,12}[\"']?\s{0,2}[:=]\s{0,2}[\"'`]?\Z", head) and re.search(r"[:=]\s{0,2}[\"'`]?\Z", head):
                out.append((m.group(), at))
                at += m.end()
                continue
            m = re.match(r"[A-Za-z0-9+/_.\-]{16,}", text[at:])
            if m and not re.search(r"[A-Za-z0-9+/_.\-]\Z", head):
                out.append((m.group(), at))
                at += m.end()
                continue
            at += 1
        found = [(c.rstrip(".=,;)"), k) for c, k in out]
        return {(c, k + 1) for c, k in found if len(c) >= 6 and (re.search("[0-9]|[a-z][A-Z]|^[A-Z]+$|[a-z]{20}", c) or len(c) < 16 or re.search(r"[^A-Za-z0-9+/_.\-]", c))}

    rows = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {}
    for x in rows:
        got.setdefault(x["doc_id"], set()).add((x["candidate"], x["position"]))
        t = texts[x["doc_id"]]
        assert t[: x["position"] - 1].endswith(x["before"]) and t[x["position"] - 1 + len(x["candidate"]) :].startswith(x["after"])
    assert {k: got.get(k, set()) for k in range(len(texts))} == {k: plain(t) for k, t in enumerate(texts)}
