"""Toxicity: maximum-scoring segments of token log-odds.

A word's score is a lower bound of its log-odds between toxic and other
documents, smoothed by a Dirichlet prior that follows the words' overall
frequencies; words without evidence cost a small amount. A linear-time
scan finds all maximal segments of positive total (Ruzzo and Tompa).
Under random words the best total follows an extreme-value distribution
whose two constants come from the word frequencies and from the clean
documents, so a segment's total and the document's length give a p-value;
the evidence of the significant segments is added up and mapped to a
probability by a logistic curve. Both curves are fitted on documents
scanned with the words of the other folds, so no document calibrates
what it taught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import held_out, ready
from siltstone.session import written

#: Labelled documents to learn from at most, folds of them, entries of a task's table of counts.
SAMPLE, FOLDS, HELD = 100_000, 4, 200_000
#: Symmetric part and strength of the prior, standard errors taken off a score, cost of a word without evidence.
EVEN, STRENGTH, DOUBT, COST = 0.5, 500.0, 2.0, 0.25
#: Expected false segments a document for which a segment counts as significant.
SIGNIFICANT = 0.5
#: From this score on a document is predicted toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, total), in one pass over the scored words.

    ``hits`` are (position, positive score) in ascending order; every
    other word costs ``cost``.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, last, total before, total through the last
    total, at = 0.0, 0
    for position, score in hits:
        before = total - cost * (position - at)
        total, at = before + score, position + 1
        first, last, left, right = position, position, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((first, last, left, right))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, r - x) for a, b, x, r in kept]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, h, y, fold)`` of at most about ``sample`` distinct labelled texts, chosen by a hash of the id; y is the mean label of equal texts, h the text's hash."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    seen = texts.join(F.broadcast(chosen), "doc_id")  # bounded by `sample`
    fold = F.pmod(F.xxhash64(F.lit("fold"), "h"), F.lit(FOLDS)).cast("int")
    return written(seen.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("y")).withColumn("fold", fold), "labelled")


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, y, fold)`` to ``(word, fold, toxic, clean)``: how often a word occurs in documents of each kind.

    A document counts each of its words once, as words of one document
    are not independent. A task keeps a bounded table and sends it on when full.
    """
    schema = pa.schema([("word", pa.string()), ("fold", pa.int32()), ("toxic", pa.float64()), ("clean", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[float]] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            batch = pa.record_batch([pa.array([w for w, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int32()), pa.array([sums[k][0] for k in keys]), pa.array([sums[k][1] for k in keys])], schema=schema)
            sums.clear()
            return batch

        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in set(_WORD.findall(text.lower())):
                    s = sums.get((word, fold))
                    if s is None:
                        sums[(word, fold)] = [y, 1 - y]
                    else:
                        s[0] += y
                        s[1] += 1 - y
                if len(sums) > HELD:
                    yield out()
        if sums:
            yield out()

    rows = docs.select("text", "y", "fold").mapInArrow(run, "word string, fold int, toxic double, clean double")
    return rows.groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_scores(counts: DataFrame, without: int | None = None) -> tuple[dict[str, float], float]:
    """Scores of the words with evidence, ``without`` a fold, and the rate at which totals of chance segments in clean text thin out.

    A word has evidence only with several toxic documents of the sample,
    so the sample bounds their number.
    """
    counts = counts.where(F.lit(True) if without is None else F.col("fold") != without).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic"), F.coalesce(F.sum("clean"), F.lit(0.0)).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return {}, 1.0
    prior = EVEN + STRENGTH * (F.col("toxic") + F.col("clean")) / (n["toxic"] + n["clean"])
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (n["toxic"] + STRENGTH)) - F.log(c / (n["clean"] + STRENGTH))
    low = odds - DOUBT * F.sqrt(1 / t + 1 / c)
    rows = counts.select("word", low.alias("low"), (c / n["clean"]).alias("share")).where("low > 0").orderBy("word").collect()  # bounded by the sample
    scores = {r["word"]: float(r["low"]) for r in rows}
    s, p = np.array([r["low"] for r in rows]), np.array([r["share"] for r in rows])
    rest = max(0.0, 1 - p.sum())
    low_rate, high_rate = 1e-6, 50.0
    for _ in range(100):  # sum of share * exp(rate * score) = 1 at a positive rate
        rate = (low_rate + high_rate) / 2
        with np.errstate(over="ignore"):
            above = len(s) and (p * np.exp(rate * s)).sum() + rest * np.exp(-rate * COST) > 1
        low_rate, high_rate = (low_rate, rate) if above else (rate, high_rate)
    return scores, min(high_rate, 5.0)


def scanned(docs: DataFrame, scores: list[dict[str, float]]) -> DataFrame:
    """``docs(doc_id, text, fold)`` to ``(doc_id, words, segments)``: word count and maximal segments with character spans, whole texts.

    ``fold`` says which of the scores a text is scanned with.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # words with evidence, bounded by the sample
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("total", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("segments", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = [], []
            for text, fold in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, scores = text or "", shared.value[fold]
                tokens = _WORD.findall(text.lower())
                hits = [(k, scores[w]) for k, w in enumerate(tokens) if w in scores]
                words.append(len(tokens))
                spans = []
                if hits:
                    kept = segments(hits)
                    ends = {k for a, b, _ in kept for k in (a, b)}
                    at = {k: m.span() for k, m in enumerate(_WORD.finditer(text)) if k in ends}
                    spans = [{"first": at[a][0] if a in at else 0, "last": at[b][1] if b in at else len(text), "total": s} for a, b, s in kept]
                found.append(spans)
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(found, pa.list_(span))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("fold").cast("int").alias("fold")).mapInArrow(run, "doc_id long, words long, segments array<struct<first:long,last:long,total:double>>")


def evidence(rate: float, scale: float):
    """The summed surprise of the significant segments, as a column."""
    surprise = lambda s: F.lit(rate) * s["total"] - F.log(F.lit(scale) * F.greatest("words", F.lit(1)))
    return F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.when(surprise(s) >= float(-np.log(SIGNIFICANT)), surprise(s)).otherwise(0.0))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and base of a logistic curve by Newton's method, lightly penalised."""
    if not len(x):
        return 1.0, -2.0
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - np.array([0.01, 0.01]) * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w + np.linalg.solve(hess, grad)
    if w[0] < 0:
        m = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, float(np.log(m / (1 - m)))
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` to (doc_id, held_out, score, predicted, evidence, segments).

    A row for each row of docs. Only labels that are not held out, of
    ``sample`` documents at most, teach; null labels, ids and texts teach
    nothing, equal texts teach their mean label once, and rows equal in
    id and text as often as they occur. A null, empty or wordless text has no segment and gets the
    base score. Without both kinds of label every score is the base
    score. Repeated rows each get a row; an empty table gives none; other
    columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    known = F.broadcast(labelled(docs, labels, sample))  # bounded by `sample`
    own = (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("h"))
    taught = docs.where("text is not null").select("doc_id", "text").join(known.withColumnRenamed("doc_id", "of"), own).select("h", "text", "y", "fold")
    counts = written(word_counts(taught), "words")
    scores, rate = word_scores(counts)
    # each labelled document scanned with the words that the other folds taught
    apart = scanned(taught.select(F.col("h").alias("doc_id"), "text", "fold"), [word_scores(counts, k)[0] for k in range(FOLDS)])
    train = written(apart.withColumnRenamed("doc_id", "h").join(known.select("h", "y"), "h"), "calibration")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["total"])), F.lit(0.0))
    # the mean of an extreme-value variable lies 0.5772 / rate above its mode
    clean = train.where("y < 0.5 and words > 0").agg(F.avg(F.lit(rate) * best - F.log("words")).alias("m")).first()["m"]
    scale = float(np.exp(np.clip((clean if clean is not None else 0.0) - 0.5772156649, -12, 12)))
    rows = train.select(evidence(rate, scale).alias("x"), "y").toPandas()  # bounded by `sample`
    slope, base = logistic(np.log1p(rows["x"].to_numpy(float)), rows["y"].to_numpy(float))
    out = scanned(docs.select("doc_id", "text", F.lit(0).alias("fold")), [scores]).withColumn("evidence", evidence(rate, scale))
    score = 1 / (1 + F.exp(-(F.lit(base) + F.lit(slope) * F.log1p("evidence"))))
    return out.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "evidence", "segments")
