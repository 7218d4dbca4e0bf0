"""Deduplication, fingerprints, decontamination (survey 2.I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators.relational import first_wins
from siltstone.registry import Tables, query

#: DuckDB's twin of ``text.collapse`` and ``text.plain``.
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
PLAIN = r"trim(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\p{{Z}}\s]+', ' ', 'g'))"


def collapse(c: str) -> str:
    return COLLAPSE.format(c)


def plain(c: str) -> str:
    return PLAIN.format(c)


@query(f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256(lower({collapse('text')})) ORDER BY doc_id) AS rn FROM documents)
SELECT lang, count(*) AS n_docs, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM d GROUP BY lang
""")
def dedup_exact(t: Tables) -> DataFrame:
    """Copies of one language shrink to a row in every task before they meet."""
    g = t.documents.groupBy(T.fingerprint("text").alias("h"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    g = g.withColumn("kept", F.col("first") == F.min("first").over(Window.partitionBy("h")))
    return g.groupBy("lang").agg(F.sum("n").alias("n_docs"), F.count_if("kept").alias("n_kept"))


def _chats(t: Tables) -> DataFrame:
    """A row for each conversation: its turns as one string in order."""
    turn = F.concat_ws("\u0001", "role", T.collapse("text"))
    w = F.array_sort(F.collect_list(F.struct("turn", turn.alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(w, lambda m: m["x"]), "\u0002").alias("body"), F.count("*").alias("turns"))


CHATS = f"""(SELECT conv_id, string_agg(role || chr(1) || {collapse('text')}, chr(2) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY conv_id)"""


@query(f"SELECT conv_id, sha256(body) AS fp, turns FROM {CHATS}")
def chat_fingerprint(t: Tables) -> DataFrame:
    return _chats(t).select("conv_id", F.sha2("body", 256).alias("fp"), "turns")


@query(f"""
WITH c AS (SELECT conv_id, sha256(body) AS fp FROM {CHATS})
SELECT conv_id, min(conv_id) OVER (PARTITION BY fp) AS kept_id,
       CASE WHEN conv_id = min(conv_id) OVER (PARTITION BY fp) THEN 'kept' ELSE 'duplicate' END AS reason
FROM c
""")
def dedup_ledger(t: Tables) -> DataFrame:
    c = _chats(t).select("conv_id", F.sha2("body", 256).alias("fp"))
    kept = c.groupBy("fp").agg(F.min("conv_id").alias("kept_id"))
    return c.join(kept, "fp").select("conv_id", "kept_id").withColumn("reason", F.when(F.col("conv_id") == F.col("kept_id"), "kept").otherwise("duplicate"))


@query(f"""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(lang || '|' || text) ORDER BY source, doc_id) AS rn FROM documents)
SELECT source, count(*) AS kept FROM d WHERE rn = 1 GROUP BY source
""")
def dedup_semantic_key(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", T.digest("lang", "text").alias("key"))
    return first_wins(d, ["key"], ["source", "doc_id"]).groupBy("source").agg(F.count("*").alias("kept"))


GROUPS = f"""(SELECT sha256(lower({collapse('text')})) AS h, source, lang FROM documents)"""


@query(f"""
WITH g AS (SELECT h, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM {GROUPS} GROUP BY h HAVING count(*) > 1)
SELECT CASE WHEN langs > 1 THEN 'cross_language' WHEN sources > 1 THEN 'cross_component' ELSE 'within_component' END AS action,
       count(*) AS n_groups, sum(n)::BIGINT AS n_rows
FROM g GROUP BY 1
""")
def collision_groups(t: Tables) -> DataFrame:
    g = t.documents.groupBy(T.fingerprint("text").alias("h")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs")).where("n > 1")
    action = F.when(F.col("langs") > 1, "cross_language").when(F.col("sources") > 1, "cross_component").otherwise("within_component")
    return g.groupBy(action.alias("action")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query(f"""
WITH g AS (SELECT DISTINCT h, source FROM {GROUPS})
SELECT a.source AS left_source, b.source AS right_source, count(*) AS n FROM g a JOIN g b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2
""")
def component_pairs(t: Tables) -> DataFrame:
    # sources are few, so a hash has a bounded set of them, and its pairs need no self-join
    g = t.documents.groupBy(T.fingerprint("text").alias("h")).agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    left = g.select(F.posexplode("s").alias("i", "left_source"), "s")
    pairs = left.select("left_source", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("right_source"))
    return pairs.groupBy("left_source", "right_source").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT sha256(text) AS h, source FROM documents WHERE length(text) >= 200)
SELECT h, count(*) AS n_sources, string_agg(source, ',' ORDER BY source) AS sources FROM w GROUP BY h HAVING count(*) > 1
""")
def source_overlap(t: Tables) -> DataFrame:
    w = t.documents.where(F.length("text") >= 200).select(F.sha2("text", 256).alias("h"), "source").distinct()
    return w.groupBy("h").agg(F.count("*").alias("n_sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")).where("n_sources > 1")


@query(f"""
WITH b AS (SELECT item_id, sha256({collapse('text')}) AS h FROM benchmark WHERE length({collapse('text')}) >= 160),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT DISTINCT doc_id, item_id FROM l JOIN b ON sha256({collapse('line')}) = b.h WHERE length({collapse('line')}) >= 160
""")
def heldout_text_match(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", T.collapse("text").alias("x")).where(F.length("x") >= 160).select("item_id", F.sha2("x", 256).alias("h"))
    lines = t.documents.select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line")).select("doc_id", T.collapse("line").alias("x"))
    return lines.where(F.length("x") >= 160).select("doc_id", F.sha2("x", 256).alias("h")).join(b, "h").select("doc_id", "item_id").distinct()


@query(f"""
WITH k AS (SELECT doc_id, source, sha256(lower({collapse('text')})) AS h FROM documents),
held AS (SELECT DISTINCT sha256(lower({collapse('text')})) AS h FROM benchmark),
f AS (SELECT k.*, first_value(source) OVER (PARTITION BY h ORDER BY source, doc_id) AS fs, row_number() OVER (PARTITION BY h ORDER BY source, doc_id) AS rn FROM k)
SELECT source, CASE WHEN h IN (SELECT h FROM held) THEN 'held_out' WHEN rn = 1 THEN 'retained' WHEN fs = source THEN 'repeat' ELSE 'already_retained' END AS reason, count(*) AS n
FROM f GROUP BY 1, 2
""")
def incremental_screen(t: Tables) -> DataFrame:
    held = t.benchmark.select(T.fingerprint("text").alias("h")).distinct().withColumn("held", F.lit(True))
    # one row for each text and source: of the first source one copy is retained and the others repeat it
    f = t.documents.groupBy(T.fingerprint("text").alias("h"), "source").agg(F.count("*").alias("n"))
    f = f.withColumn("first", F.row_number().over(Window.partitionBy("h").orderBy("source")) == 1).join(held, "h", "left")
    counted = lambda name, n: F.struct(F.lit(name).alias("reason"), n.cast("long").alias("k"))
    n = F.col("n")
    reasons = F.when(F.col("held"), F.array(counted("held_out", n))).when(F.col("first"), F.array(counted("retained", F.lit(1)), counted("repeat", n - 1))).otherwise(F.array(counted("already_retained", n)))
    return f.select("source", F.inline(reasons)).where("k > 0").groupBy("source", "reason").agg(F.sum("k").alias("n"))


CONTEXT = """(SELECT conv_id, turn, role, text,
  coalesce(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context,
  lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


def _contexts(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    prior = F.collect_list(F.concat_ws("\u0001", "role", "text")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.conversations.select("conv_id", "turn", "role", "text", F.array_join(prior, "\u0002").alias("context"), F.lag("text").over(w).alias("before"))


@query(f"""
WITH a AS (SELECT conv_id, turn, sha256(context) AS c, sha256(before || chr(1) || text) AS p FROM {CONTEXT} WHERE role = 'assistant' AND turn > 0),
h AS (SELECT * FROM a WHERE conv_id % 5 = 0), r AS (SELECT * FROM a WHERE conv_id % 5 <> 0)
SELECT conv_id, turn, c IN (SELECT c FROM h) AS context_hit, p IN (SELECT p FROM h WHERE p IS NOT NULL) AS pair_hit FROM r WHERE c IN (SELECT c FROM h) OR p IN (SELECT p FROM h WHERE p IS NOT NULL)
""")
def context_overlap(t: Tables) -> DataFrame:
    """Conversations of every fifth id stand in for a held-out set; the others are looked up in it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    place = F.row_number().over(w)
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("before"), place.alias("place"))
    # a context is told by a rolling hash of its turns and their places, so no turn carries its history
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    rolled = F.struct((F.col("place") - 1).alias("n"), *(F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "place", "role", "text")).over(prior), F.lit(0)).alias(f"h{k}") for k in (1, 2)))
    a = turns.select("conv_id", "turn", "role", rolled.alias("c"), F.sha2(F.concat("before", F.lit("\u0001"), "text"), 256).alias("p")).where("role = 'assistant' and turn > 0")
    held = a.where("conv_id % 5 = 0")
    c = held.select("c").distinct().withColumn("context_hit", F.lit(True))
    p = held.select("p").where("p is not null").distinct().withColumn("pair_hit", F.lit(True))
    rest = a.where("conv_id % 5 <> 0").join(c, "c", "left").join(p, "p", "left").fillna(False, ["context_hit", "pair_hit"])
    return rest.where("context_hit or pair_hit").select("conv_id", "turn", "context_hit", "pair_hit")


@query(f"SELECT item_id, {plain('text')} AS normalized, sha256({plain('text')}) AS h FROM benchmark")
def decontam_normalize(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.plain("text").alias("normalized")).withColumn("h", F.sha2("normalized", 256))


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def grams(w: str, n: int) -> str:
    """Distinct runs of n words of a list column."""
    return f"list_distinct(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i+{n - 1}], ' ')))"


@query(f"""
WITH bw AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark), dw AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, unnest({grams('w', 8)}) AS g FROM bw), d AS (SELECT doc_id, unnest({grams('w', 8)}) AS g FROM dw)
SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY 1, 2
""")
def decontam_exact_join(t: Tables) -> DataFrame:
    """Distinct runs of eight words that a document shares with a benchmark item."""
    b = t.benchmark.select("item_id", F.explode_outer(T.ngrams(T.words("text"), 8)).alias("g")).where("g is not null").select("item_id", F.xxhash64("g").alias("h"), "g")
    words = t.documents.select("doc_id", T.words("text").alias("w"))
    # hashes of runs alone find the documents; the runs themselves are made of those only
    starts = F.when(F.size("w") >= 8, F.sequence(F.lit(1), F.size("w") - 7)).otherwise(F.array().cast("array<int>"))
    marks = t.benchmark.select(T.words("text").alias("w")).select(F.explode_outer(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, 8)))).alias("m")).where("m is not null").distinct()
    spots = words.select("doc_id", F.explode_outer(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, 8)))).alias("m")).where("m is not null")
    asked = words.join(spots.join(marks, "m", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    d = asked.select("doc_id", F.explode_outer(T.ngrams(F.col("w"), 8)).alias("g")).where("g is not null")
    return d.withColumn("h", F.xxhash64("g")).join(b, ["h", "g"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w, {WORDS.format('substr(text, 1, length(text) // 2)')} AS v FROM documents),
p AS (SELECT doc_id, {grams('w', 5)} AS b, {grams('v', 5)} AS a FROM w)
SELECT doc_id, CASE WHEN len(b) > 0 THEN round(len(list_intersect(a, b)) / len(b), 6) END AS overlap, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) <= 0.08 ELSE true END AS keep FROM p
""")
def ngram_overlap(t: Tables) -> DataFrame:
    half = F.substr(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    p = t.documents.select("doc_id", T.words("text").alias("wb"), T.words(half).alias("wa")).select("doc_id", T.ngrams(F.col("wb"), 5).alias("b"), T.ngrams(F.col("wa"), 5).alias("a"))
    ratio = F.try_divide(F.size(F.array_intersect("a", "b")), F.size("b"))
    return p.select("doc_id", F.round(ratio, 6).alias("overlap"), F.coalesce(ratio <= 0.08, F.lit(True)).alias("keep"))


@query(f"""
WITH c AS (SELECT conv_id, turn, list_distinct({WORDS.format('text')}) AS b, list_distinct({WORDS.format('before')}) AS a FROM {CONTEXT} WHERE before IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS coefficient FROM c
""")
def overlap_coefficient(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", F.array_distinct(T.words("text")).alias("b"), F.lag("text").over(w).alias("before")).where("before is not null")
    c = c.withColumn("a", F.array_distinct(T.words("before")))
    return c.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.least(F.size("a"), F.size("b"))), F.lit(0.0)), 6).alias("coefficient"))


@query(f"""
WITH w AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
p AS (SELECT item_id, unnest([w[1:20], w[len(w) // 2 - 9:len(w) // 2 + 10], w[len(w) - 19:len(w)]]) AS probe, unnest(['head', 'middle', 'tail']) AS place FROM w WHERE len(w) >= 20),
d AS (SELECT doc_id, ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS hay FROM documents)
SELECT doc_id, item_id, place FROM d JOIN p ON contains(hay, ' ' || array_to_string(probe, ' ') || ' ')
""")
def token_leak(t: Tables) -> DataFrame:
    """Probes of twenty words are joined by hash instead of being searched in every document."""
    w = t.benchmark.select("item_id", T.words("text").alias("w")).where(F.size("w") >= 20)
    mid = F.floor(F.size("w") / 2).cast("int")
    probes = F.array(
        F.struct(F.lit("head").alias("place"), F.slice("w", 1, 20).alias("p")),
        F.struct(F.lit("middle").alias("place"), F.slice("w", mid - 9, F.lit(20)).alias("p")),
        F.struct(F.lit("tail").alias("place"), F.slice("w", F.size("w") - 19, F.lit(20)).alias("p")),
    )
    p = w.select("item_id", F.explode(probes).alias("x")).select("item_id", "x.place", F.array_join("x.p", " ").alias("g"))
    d = t.documents.select("doc_id", T.words("text").alias("w")).select("doc_id", F.explode_outer(T.ngrams(F.col("w"), 20)).alias("g")).where("g is not null")
    return d.join(p, "g").select("doc_id", "item_id", "place").distinct()


@query(f"SELECT conv_id, turn, sha256(context || chr(3) || text) AS fp FROM {CONTEXT} WHERE role = 'assistant'")
def target_fingerprint(t: Tables) -> DataFrame:
    return _contexts(t).where("role = 'assistant'").select("conv_id", "turn", F.sha2(F.concat("context", F.lit("\u0003"), "text"), 256).alias("fp"))


@query("SELECT b.doc_id, min(a.doc_id) AS first_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id GROUP BY b.doc_id")
def hash_verify_dedup(t: Tables) -> DataFrame:
    """Texts meet by hash; full equality decides. One row of each text stands for its copies, so copies make no pairs."""
    d = t.documents.select("doc_id", F.xxhash64("text").alias("h"), "text")
    first = d.groupBy("h", "text").agg(F.min("doc_id").alias("first_id"))
    return d.alias("d").join(first.alias("f"), (F.col("d.h") == F.col("f.h")) & (F.col("d.text") == F.col("f.text"))).where("doc_id > first_id").select("doc_id", "first_id")


@query(f"""
WITH s AS (SELECT sha256(lower({collapse('text')})) AS h, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS scope FROM documents)
SELECT h, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes, count(*) AS n FROM s GROUP BY h HAVING count(DISTINCT scope) > 1
""")
def scope_conflict(t: Tables) -> DataFrame:
    scope = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    s = t.documents.groupBy(T.fingerprint("text").alias("h")).agg(F.array_sort(F.collect_set(scope)).alias("s"), F.count("*").alias("n")).where(F.size("s") > 1)
    return s.select("h", F.array_join("s", ",").alias("scopes"), "n")
