"""Retrieval, evidence checking, agreement, sequence labels, model-backed surface (survey 2.P and 2.Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators import relational as R
from siltstone.operators import grams, judge, pool
from siltstone.registry import Tables, query
from siltstone.session import written

#: Rows of a query side up to which it is sent to every task.
SENT = 1_000_000
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
# Frequent short words of each language.
STOPWORDS = {"de": "der die das und ist nicht", "en": "the of and to in is", "es": "el los las que y del", "fr": "le les des et est une"}


@query("""
WITH d AS (SELECT doc_id, ' ' || array_to_string(%s, ' ') || ' ' AS s FROM documents), p AS (SELECT doc_id, %s FROM d)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang FROM p
""" % (WORDS, ", ".join("(" + " + ".join(f"(length(s) - length(replace(s, ' {w} ', '')))" for w in x.split()) + f") AS {k}" for k, x in STOPWORDS.items())))
def lang_id_stopwords(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.concat(F.lit(" "), F.array_join(T.words("text"), " "), F.lit(" ")).alias("s"))
    hit = lambda w: F.length("s") - F.length(F.replace("s", F.lit(f" {w} "), F.lit("")))
    p = d.select("doc_id", *(sum((hit(w) for w in x.split()), F.lit(0)).alias(k) for k, x in STOPWORDS.items()))
    top = F.greatest(*STOPWORDS)
    return p.select("doc_id", T.first_rule([(top == 0, "unknown"), *((F.col(k) == top, k) for k in STOPWORDS)]).alias("lang"))


@query("""
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pairs(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "vec_id").select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"), F.round(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")), 5).alias("cosine"))


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.x, e.embedding::DOUBLE[]), 5) AS score FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def knn_topk(t: Tables) -> DataFrame:
    """Neighbours within the query's own label; labels are the blocks."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("y").alias("x"))
    dot = F.aggregate(F.zip_with("x", "y", lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    s = q.join(e, "label").where("query_id <> vec_id").select("query_id", "vec_id", F.round(dot, 5).alias("score"))
    return R.bottom_k(s, ["query_id"], [F.desc("score"), F.col("vec_id")], 5).select("query_id", "vec_id", "rank")


@query("""
WITH v AS (SELECT doc_id, length(text) BETWEEN 300 AND 20000 AND text NOT LIKE '%password%' AS keep, doc_id % 7 = 0 AS cut FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN cut THEN 'error' ELSE 'done' END AS state, CASE WHEN cut THEN 3 ELSE 1 + (doc_id % 5 = 1)::INT END AS attempts, CASE WHEN NOT cut THEN keep END AS keep FROM v
""")
def judge_endpoint(t: Tables) -> DataFrame:
    """A judge asked about every document, with retries; a stub stands for the model: each seventh answer is cut off, and some first attempts fail."""
    found = judge.asked(t.documents.where("text is not null").select(F.col("doc_id").alias("key"), F.col("text").alias("prompt")), judge.Stub(), attempts=3, wait=0.0)
    verdict = F.from_json("answer", "keep boolean")
    return found.select(F.col("key").alias("doc_id"), "state", "attempts", F.when(F.col("state") == "done", verdict["keep"]).alias("keep"))


@query("SELECT lang, count(*) AS n, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS kept FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def judge_join(t: Tables) -> DataFrame:
    """The table of labels stands for a judge's verdicts."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("kept"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents")
def pool_map(t: Tables) -> DataFrame:
    """A Python function over batches in a pool of workers; the ordinal puts results back in the order of the input."""
    d = R.prefix(t.documents.select("doc_id", "text"), [], ["doc_id"], R.by_value("doc_id"), F.lit(1), "ordinal")
    return pool.mapped(d, ["doc_id", "ordinal"], "text", lambda texts: [None if x is None else x.count("\n") for x in texts], "breaks long")


@query("""
SELECT item_id, unit, count(*) AS n FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, '[.\\n]'), lambda x: length(trim(x)) > 20)) AS u, 'sentence' AS unit FROM benchmark UNION ALL SELECT item_id, text, 'whole' FROM benchmark) GROUP BY 1, 2
""".replace("\\\\", "\\"))
def udtf_units(t: Tables) -> DataFrame:
    parts = F.filter(F.split("text", r"[.\n]"), lambda x: F.length(F.trim(x)) > 20)
    units = F.concat(F.transform(parts, lambda x: F.lit("sentence")), F.array(F.lit("whole")))
    return t.benchmark.select("item_id", F.explode(units).alias("unit")).groupBy("item_id", "unit").agg(F.count("*").alias("n"))


@query(f"""
WITH tok AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), c AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark)),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN len USING (doc_id) CROSS JOIN c GROUP BY 1, 2)
SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5
""")
def bm25_search(t: Tables) -> DataFrame:
    """Postings only of words that a query holds; lengths and counts over all documents. A document's words lie in one task, which ranks its own documents first."""
    q = t.benchmark.select("item_id", F.explode_outer(F.array_distinct(T.words("text"))).alias("w")).where("w is not null")
    docs = t.documents.select("doc_id", T.words("text").alias("ws")).where(F.size("ws") > 0).repartition("doc_id")
    c = docs.agg(F.count("*").alias("docs"), F.avg(F.size("ws")).alias("mean"))  # one row
    asked = _side(q.select("w").distinct(), "words")
    tf = docs.select("doc_id", F.size("ws").alias("n"), F.explode_outer("ws").alias("w")).join(asked, "w", "left_semi").groupBy("doc_id", "n", "w").agg(F.count("*").alias("tf"))
    items = _side(q.join(tf.groupBy("w").agg(F.count("*").alias("df")), "w"), "items")
    s = tf.join(items, "w").crossJoin(F.broadcast(c))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    s = s.groupBy("doc_id", "item_id").agg(F.round(F.sum(term), 6).alias("score"))
    return R.bottom_k(s, ["item_id"], [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "rank")


def _side(df: DataFrame, name: str) -> DataFrame:
    """The side of a join that grows with the queries: written, counted, and sent to every task if small enough."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= SENT else df


def _char_grams(name: str, id_: str) -> str:
    return f"(SELECT {id_}, g, count(*) AS tf FROM (SELECT {id_}, unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, length(x) - k + 2), lambda i: substr(x, i, k))))) AS g FROM (SELECT {id_}, lower(text) AS x FROM {name})) GROUP BY 1, 2)"


@query(f"""
WITH d AS {_char_grams('documents', 'doc_id')}, q AS {_char_grams('benchmark', 'item_id')}, df AS (SELECT g, count(*) AS df FROM d GROUP BY g), n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
dw AS (SELECT doc_id, g, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM d JOIN df USING (g) CROSS JOIN n), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
qw AS (SELECT item_id, g, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM q JOIN df USING (g) CROSS JOIN n), qv AS (SELECT item_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS v FROM qw),
s AS (SELECT item_id, doc_id, round(sum(v * w) / max(norm), 7) AS score FROM qv JOIN dw USING (g) JOIN dn USING (doc_id) GROUP BY 1, 2)
SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3
""")
def char_tfidf_rank(t: Tables) -> DataFrame:
    """Cosine of TF-IDF weighted character 3- to 5-grams of whole texts."""
    return grams.tfidf_top(t.documents, t.benchmark, 3).select("item_id", "doc_id", "rank")


@query(f"""
WITH o AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents), q AS (SELECT item_id, list_distinct({WORDS}) AS v FROM benchmark), s AS (SELECT item_id, doc_id, len(list_intersect(w, v)) AS n FROM q CROSS JOIN o)
SELECT item_id, doc_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM s WHERE n > 0) WHERE rank <= 5
""")
def lexical_topk(t: Tables) -> DataFrame:
    q = _side(t.benchmark.select("item_id", F.explode_outer(F.array_distinct(T.words("text"))).alias("w")).where("w is not null"), "words")
    o = t.documents.select("doc_id", F.array_distinct(T.words("text")).alias("ws")).repartition("doc_id")
    s = o.select("doc_id", F.explode_outer("ws").alias("w")).join(q, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
    return R.bottom_k(s, ["item_id"], [F.desc("n"), F.col("doc_id")], 5).select("item_id", "doc_id", "n", "rank")


@query("""
WITH o AS (SELECT doc_id, 'labels' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 800 UNION ALL SELECT doc_id, 'verified' FROM documents WHERE doc_id % 6 = 0)
SELECT doc_id, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM o GROUP BY doc_id
""")
def candidate_fusion(t: Tables) -> DataFrame:
    tagged = lambda df, name: df.select("doc_id", F.lit(name).alias("origin"))
    o = tagged(t.labels.where("quality = 1"), "labels").unionByName(tagged(t.documents.where("n_chars < 800"), "short")).unionByName(tagged(t.documents.where("doc_id % 6 = 0"), "verified"))
    return o.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


@query("SELECT doc_id, k AS start, substr(text, k + 1, 3000) AS body FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS k FROM documents)")
def sliding_char_windows(t: Tables) -> DataFrame:
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(1800)))
    w = F.transform(starts, lambda k: F.struct(k.cast("long").alias("start"), F.substr(F.col("text"), k + 1, F.lit(3000)).alias("body")))
    return t.documents.select("doc_id", F.explode_outer(w).alias("w")).where("w is not null").select("doc_id", "w.*")


@query("""
WITH RECURSIVE w AS (SELECT doc_id, start, n, row_number() OVER (PARTITION BY doc_id ORDER BY ('0x' || substr(sha256('w|' || doc_id || '|' || start), 1, 15))::BIGINT, start, n) AS k
  FROM (SELECT doc_id, start, least(3000, length(text) - start) AS n FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS start FROM documents))),
c AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS s, []::BIGINT[] AS e FROM (SELECT DISTINCT doc_id FROM w) UNION ALL
  SELECT c.doc_id, w.k, CASE WHEN len(s) < 3 AND NOT hit THEN list_append(s, w.start) ELSE s END, CASE WHEN len(s) < 3 AND NOT hit THEN list_append(e, w.start + w.n) ELSE e END
  FROM (SELECT c.*, w.k AS next, coalesce(list_bool_or(list_transform(list_zip(c.s, c.e), lambda x: least(x[2], w.start + w.n) - greatest(x[1], w.start) > 1200)), false) AS hit FROM c JOIN w ON w.doc_id = c.doc_id AND w.k = c.k + 1) c
  JOIN w ON w.doc_id = c.doc_id AND w.k = c.next)
SELECT doc_id, unnest(s) AS start FROM (SELECT doc_id, arg_max(s, k) AS s FROM c GROUP BY doc_id)
""")
def overlap_suppression(t: Tables) -> DataFrame:
    """Windows of a document by hash order; one that shares over 1200 characters with a chosen one is skipped; three at most."""
    w = sliding_char_windows(t).select("doc_id", "start", T.hash60(T.digest(F.lit("w"), "doc_id", "start")).alias("h"), F.length("body").alias("n"))
    ranked = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("h", "start", "n"))).alias("ws"))
    shares = lambda a, b: F.least(a["start"] + a["n"], b["start"] + b["n"]) - F.greatest(a["start"], b["start"]) > 1200
    chosen = F.aggregate("ws", F.slice("ws", 1, 0), lambda c, x: F.when((F.size(c) < 3) & ~F.exists(c, lambda y: shares(x, y)), F.concat(c, F.array(x))).otherwise(c))
    return ranked.select("doc_id", F.explode(chosen).alias("c")).select("doc_id", "c.start")


@query("""
WITH RECURSIVE l AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY line <> 0, n DESC, line) AS k FROM
  (SELECT doc_id, unnest(range(0, len(x))) AS line, length(unnest(x)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
s AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS held FROM l UNION ALL
  SELECT s.doc_id, l.k, CASE WHEN line = 0 OR (len(held) < 10 AND used + n <= 1500) THEN used + n ELSE used END, CASE WHEN line = 0 OR (len(held) < 10 AND used + n <= 1500) THEN list_append(held, line) ELSE held END
  FROM s JOIN l ON l.doc_id = s.doc_id AND l.k = s.k + 1)
SELECT doc_id, used::INTEGER AS used, unnest(held)::INTEGER AS line FROM (SELECT doc_id, arg_max(used, k) AS used, arg_max(held, k) AS held FROM s GROUP BY doc_id)
""")
def evidence_budget(t: Tables) -> DataFrame:
    """Lines of a document by length, taken while 1500 characters last, ten at most; the first line always."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i != 0).alias("later"), (-F.length(x)).alias("k"), i.alias("i"), F.length(x).alias("n")))
    state = F.aggregate(
        F.array_sort(lines), F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("at")),
        lambda s, x: F.when((~x["later"]) | ((F.size(s["at"]) < 10) & (s["used"] + x["n"] <= 1500)), F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["at"], F.array(x["i"])).alias("at"))).otherwise(s),
    )
    return t.documents.select("doc_id", state.alias("s")).select("doc_id", "s.used", F.explode("s.at").alias("line"))


@query("SELECT page_id, list_max(list_transform(regexp_extract_all(url, '/([0-9]{4})', 1), lambda x: x::INT)) > 8000 AS leaks FROM pages")
def temporal_leak_filter(t: Tables) -> DataFrame:
    """Numbers in the address stand for dates, 8000 for the sample's time."""
    found = F.transform(F.regexp_extract_all("url", F.lit("/([0-9]{4})"), F.lit(1)), lambda x: x.cast("int"))
    return t.pages.select("page_id", (F.array_max(found) > 8000).alias("leaks"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages), k AS (SELECT DISTINCT '/' || lang AS link FROM documents UNION SELECT '/the')
SELECT page_id, count(*) AS links, sum((link NOT IN (SELECT link FROM k))::INT)::BIGINT AS unknown FROM l GROUP BY page_id
""")
def citation_antijoin(t: Tables) -> DataFrame:
    known = t.documents.select(F.concat(F.lit("/"), "lang").alias("link")).union(t.spark.createDataFrame([("/the",)], "link string")).distinct().withColumn("known", F.lit(True))
    links = t.pages.select("page_id", F.explode_outer(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("link")).where("link is not null")
    return links.join(known, "link", "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("known").isNull()).alias("unknown"))


CLAIMS = "(SELECT doc_id, 10 + (doc_id % 3 = 2)::INT AS start, 30 + (doc_id % 3 = 2)::INT AS stop, CASE WHEN doc_id % 3 = 1 THEN upper(substr(text, 11, 20)) ELSE substr(text, 11, 20) END AS excerpt FROM documents WHERE text IS NOT NULL)"


@query(f"""
SELECT doc_id, start < stop AND stop <= length(text) AND substr(text, start + 1, stop - start) = excerpt AS ok, excerpt <> '' AND (length(text) - length(replace(text, excerpt, ''))) = length(excerpt) AS once
FROM {CLAIMS} JOIN documents USING (doc_id)
""")
def excerpt_verify(t: Tables) -> DataFrame:
    """Excerpts as they were delivered, with their offsets, against the kept text of their source: some are true, some altered, some misplaced."""
    moved = (F.col("doc_id") % 3 == 2).cast("int")
    part = F.substring("text", 11, 20)
    claims = t.documents.where("text is not null").select("doc_id", (moved + 10).alias("start"), (moved + 30).alias("stop"), F.when(F.col("doc_id") % 3 == 1, F.upper(part)).otherwise(part).alias("excerpt"))
    return verified(claims, t.documents.select("doc_id", "text"))


def verified(claims: DataFrame, kept: DataFrame) -> DataFrame:
    """``claims(doc_id, start, stop, excerpt)`` against ``kept(doc_id, text)``: (doc_id, ok, once)."""
    size, stop = F.length("text"), F.col("stop")
    ok = (F.col("start") >= 0) & (F.col("start") < stop) & (stop <= size) & (F.substr(F.col("text"), F.col("start") + 1, stop - F.col("start")) == F.col("excerpt"))
    gone = size - F.length(F.replace(F.col("text"), F.col("excerpt"), F.lit("")))
    return claims.join(kept, "doc_id").select("doc_id", ok.alias("ok"), ((F.col("excerpt") != "") & (gone == F.length("excerpt"))).alias("once"))


@query(None)
def suffix_anchor(t: Tables) -> DataFrame:
    """The end of the first line's longest suffix, of 256 characters at most, that occurs once in the text."""
    line = F.substring_index("text", "\n", 1)
    n = F.least(F.length(line), F.lit(256))
    once = lambda k: (F.length("text") - F.length(F.replace("text", F.right(line, k), F.lit("")))) == k
    sizes = F.when(n > 0, F.filter(F.sequence(n, F.lit(1), F.lit(-8)), lambda k: (k > 0) & once(k)))
    best = F.try_element_at(sizes, F.lit(1))
    return t.documents.select("doc_id", best.alias("size"), (F.position(F.right(line, best), F.col("text")) + best).alias("end"))


REVIEWS = "(SELECT doc_id, quality AS a, CASE WHEN doc_id % 5 = 0 THEN 1 - quality WHEN doc_id % 23 = 0 THEN NULL ELSE quality END AS b FROM labels)"


@query(f"SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a <> b THEN 'disagree' WHEN a = 1 THEN 'both_keep' ELSE 'both_reject' END AS state, count(*) AS n FROM {REVIEWS} GROUP BY 1")
def reviewer_agreement(t: Tables) -> DataFrame:
    second = F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).when(F.col("doc_id") % 23 != 0, F.col("quality"))
    r = t.labels.select(F.col("quality").alias("a"), second.alias("b"))
    state = T.first_rule([(F.col("b").isNull(), "missing"), (F.col("a") != F.col("b"), "disagree"), (F.col("a") == 1, "both_keep")], "both_reject")
    return r.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""
SELECT lang, count(*) AS n, count(b) AS valid, sum((b IS NULL)::INT)::BIGINT AS missing, sum((a = b)::INT)::BIGINT AS agree, sum((a = 0 AND b = 1)::INT)::BIGINT AS false_accepts
FROM {REVIEWS} JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))
""")
def review_calibration(t: Tables) -> DataFrame:
    second = F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).when(F.col("doc_id") % 23 != 0, F.col("quality"))
    r = t.labels.select("doc_id", F.col("quality").alias("a"), second.alias("b")).join(t.documents.select("doc_id", "lang"), "doc_id")
    return r.rollup("lang").agg(
        F.count("*").alias("n"), F.count("b").alias("valid"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a") == F.col("b")).alias("agree"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("false_accepts")
    )


@query("""
WITH u AS (SELECT l_partkey, count(*) AS used FROM lineitem GROUP BY 1)
SELECT p_partkey FROM part LEFT JOIN u ON p_partkey = l_partkey WHERE coalesce(used, 0) < 40 ORDER BY (p_partkey <= 500)::INT, p_partkey LIMIT 10
""")
def reuse_cap(t: Tables) -> DataFrame:
    """The next sources after a cursor at 500, wrapped around, that are used less than 40 times."""
    u = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("used"))
    p = t.part.join(u, F.col("p_partkey") == F.col("l_partkey"), "left").where(F.coalesce("used", F.lit(0)) < 40)
    return p.orderBy((F.col("p_partkey") <= 500).cast("int"), "p_partkey").limit(10).select("p_partkey")


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 10 <> 3 AND source <> 'src7')
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM d WHERE rn = 1
""")
def exclusion_chain(t: Tables) -> DataFrame:
    d = t.documents.where("doc_id % 10 <> 3 and source <> 'src7'").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    kept = R.first_wins(d, ["h"], ["doc_id"]).select("source", "doc_id")
    return R.prefix(kept, ["source"], ["doc_id"], R.by_value("doc_id"), F.lit(1), "before").select("source", "doc_id", (F.col("before") + 1).alias("seq"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'added' ELSE 'present' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def missing_backfill(t: Tables) -> DataFrame:
    d, jobs = t.documents.select("doc_id"), t.labels.select("doc_id")
    added = d.join(jobs, "doc_id", "left_anti").select(F.lit("added").alias("state"))
    return d.join(jobs, "doc_id", "left_semi").select(F.lit("present").alias("state")).unionByName(added).groupBy("state").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT doc_id, source, sha256('breadth|' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS rn FROM d)
SELECT doc_id, source FROM r ORDER BY (rn > 1)::INT, h LIMIT 40
""")
def breadth_first_select(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", T.digest(F.lit("breadth"), "doc_id").alias("h"))
    top = R.bottom_k(d, ["source"], ["h"], 40)
    return top.orderBy((F.col("rank") > 1).cast("int"), "h").limit(40).select("doc_id", "source")


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256('cap|' || doc_id), doc_id) AS rn FROM documents WHERE n_chars > 0),
o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY rn, source) AS k FROM r),
s AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS doc_id UNION ALL
  SELECT o.k, CASE WHEN used + n_chars <= 100000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 100000 THEN o.doc_id END FROM s JOIN o ON o.k = s.k + 1)
SELECT doc_id FROM s WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id FROM documents WHERE n_chars = 0
""")
def byte_cap_select(t: Tables) -> DataFrame:
    """Sources in rounds by hash, up to 100,000 characters in all; an item that would pass the cap is skipped, and smaller ones may follow."""
    d = t.documents.where("n_chars > 0").select("doc_id", "source", "n_chars", T.digest(F.lit("cap"), "doc_id").alias("h"))
    ranked = R.prefix(d, ["source"], ["h", "doc_id"], R.by_digits("h"), F.lit(1), "rank")
    taken = capped(written(ranked.select("rank", "source", "doc_id", "n_chars"), "ranked"), ["rank", "source", "doc_id"], "n_chars", 100000)
    chosen = t.spark.createDataFrame([(r["doc_id"],) for r in taken], "doc_id long")
    return chosen.unionByName(t.documents.where("n_chars = 0").select("doc_id"))


def capped(rows: DataFrame, order: list[str], size: str, cap: int, step: int = 1000) -> list[Row]:
    """Rows in order while their sizes, all above 0, fit under the cap; those too large are passed over.

    The first ``step`` rows that still fit are looked at, then the next
    ones after them, so each round takes a row at least and few rounds
    are needed; no task sees all rows in order.
    """
    taken, used, last = [], 0, None
    while used < cap:
        left = rows.where(F.col(size) <= cap - used)
        if last is not None:
            left = left.where(F.struct(*order) > F.struct(*(F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in order)))
        found = left.orderBy(*order).limit(step).collect()  # `step` rows
        for r in found:
            if used + r[size] <= cap:
                taken.append(r)
                used += r[size]
        if len(found) < step:
            break
        last = found[-1]
    return taken


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('g|' || doc_id)) AS rn FROM documents)
SELECT rn AS depth, source, doc_id FROM r WHERE rn <= 3
""")
def interleave_schedule(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", T.digest(F.lit("g"), "doc_id").alias("h"))
    return R.bottom_k(d, ["source"], ["h"], 3).select(F.col("rank").alias("depth"), "source", "doc_id")


@query("""
WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events)
SELECT user_id, CASE WHEN count(CASE WHEN delta >= 0 THEN delta END) = count(*) - 1 THEN round(sum(delta), 4) END AS strict_total, sum((delta < 0)::INT)::BIGINT AS resets FROM d GROUP BY user_id
""")
def counter_rate(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = t.events.select("user_id", (F.col("value") - F.lag("value").over(w)).alias("delta"))
    up = F.count(F.when(F.col("delta") >= 0, F.col("delta")))
    return d.groupBy("user_id").agg(F.when(up == F.count("*") - 1, F.round(F.sum("delta"), 4)).alias("strict_total"), F.sum((F.col("delta") < 0).cast("int")).alias("resets"))


@query("""
WITH RECURSIVE j AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT DISTINCT o_custkey, 0::BIGINT AS k, [0, 0, 0, 0]::DOUBLE[] AS lanes FROM orders UNION ALL
  SELECT s.o_custkey, j.k, list_sort(list_concat([lanes[1] + o_totalprice], lanes[2:4])) FROM s JOIN j ON j.o_custkey = s.o_custkey AND j.k = s.k + 1)
SELECT o_custkey, round(max(lanes[4]), 4) AS makespan FROM s GROUP BY o_custkey
""")
def makespan_eta(t: Tables) -> DataFrame:
    """Each customer's orders are a queue of jobs in key order, each onto the least loaded of 4 lanes."""
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("xs"))
    lanes = F.aggregate("xs", F.array_repeat(F.lit(0.0), 4), lambda a, x: F.array_sort(F.concat(F.array(F.element_at(a, 1) + x["o_totalprice"]), F.slice(a, 2, 3))))
    return g.select("o_custkey", F.round(F.array_max(lanes), 4).alias("makespan"))


@query("""
WITH r AS (SELECT doc_id, quality AS old, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE quality * (doc_id % 3 > 0)::INT END AS new FROM labels)
SELECT CASE WHEN new > old THEN 'improved' WHEN new < old THEN 'regressed' ELSE 'same' END AS delta, count(*) AS n FROM r GROUP BY 1
""")
def outcome_delta(t: Tables) -> DataFrame:
    old = F.col("quality")
    new = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(old * (F.col("doc_id") % 3 > 0).cast("int"))
    return t.labels.groupBy(T.first_rule([(new > old, "improved"), (new < old, "regressed")], "same").alias("delta")).agg(F.count("*").alias("n"))


@query("SELECT max(l_orderkey + l_quantity::BIGINT) <= (SELECT max(o_orderkey) + 60 FROM orders) AS inside, sum((l_quantity < 0)::INT)::BIGINT AS negative FROM lineitem")
def offset_bounds(t: Tables) -> DataFrame:
    store = t.orders.agg((F.max("o_orderkey") + 60).alias("store"))  # one row
    ends = t.lineitem.agg(F.max(F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("last"), F.count_if(F.col("l_quantity") < 0).alias("negative"))
    return ends.crossJoin(F.broadcast(store)).select((F.col("last") <= F.col("store")).alias("inside"), "negative")


#: Lines of an order in a total order; line numbers repeat.
LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate"]


@query(f"""
WITH n AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINES)}) AS k FROM lineitem),
t AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'O' WHEN l_returnflag = coalesce(lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY k), '') THEN 'I' ELSE 'B' END AS tag FROM n),
s AS (SELECT *, sum((tag = 'B')::INT) OVER (PARTITION BY l_orderkey ORDER BY k) AS span FROM t)
SELECT l_orderkey, span::BIGINT AS span, min(k) AS first, max(k) AS last, min(l_returnflag) AS kind FROM s WHERE tag <> 'O' GROUP BY 1, 2
""")
def bio_spans(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_orderkey", "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINES)).alias("k"))
    w = Window.partitionBy("l_orderkey").orderBy("k")
    tag = F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == F.coalesce(F.lag("l_returnflag").over(w), F.lit("")), "I").otherwise("B")
    s = R.islands(n.withColumn("tag", tag), ["l_orderkey"], ["k"], F.col("tag") == "B", "span")
    return s.where("tag <> 'O'").groupBy("l_orderkey", "span").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min("l_returnflag").alias("kind"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM i GROUP BY l_orderkey, g
""")
def contiguous_mentions(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    i = t.lineitem.where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - F.row_number().over(w)).alias("g"))
    return i.groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last")).drop("g")
