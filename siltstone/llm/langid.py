"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into columns, as many as
keep the weights of all languages within a bound. Document frequencies
are counted over every learning document; the classifier is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded
sample of each language, a part of which sets the temperature of the
probabilities. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, held_out, ready
from siltstone.session import written

#: Bits of the columns n-grams are hashed to, at most and at least; bits of columns times languages at most, while the least allows it.
BITS, LEAST_BITS, WEIGHT_BITS = 15, 10, 22
#: Documents the classifier is fitted on at most (one of each language at least), and their entries together.
SAMPLE, ENTRIES = 4000, 16 << 20
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letters(text: str | None) -> str:
    """Lower-case letters with single spaces between and around words; empty if there is none."""
    words = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def bits_for(languages: int) -> int:
    return max(LEAST_BITS, min(BITS, WEIGHT_BITS - (languages - 1).bit_length()))


def counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """How often each column's n-grams occur in the whole text; null for a text without a letter."""
    clean = letters(text)
    if not clean:
        return None
    out = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(clean), 1 << 20):  # a long text in pieces that overlap by two characters
        c = np.frombuffer(clean[at : at + (1 << 20) + 2].encode("utf-32-le"), "<u4")
        end = min(1 << 20, len(clean) - at)
        one = c * _SALTS[0]
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * _SALTS[1] + c[1:] * _SALTS[2]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * _SALTS[2] + c[2:] * _SALTS[0]
        for h in (one, two * _SALTS[0], three * _SALTS[1]):
            out += np.bincount((h[:end] >> shift).astype(np.int64), minlength=1 << bits)
    return out


def features(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and TF-IDF values of unit length."""
    at = np.flatnonzero(found)
    value = np.sqrt(found[at]) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int = BITS

    def probabilities(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return softmax((value @ self.weights[at] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, columns: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal, one learning rate for each coordinate; ``rows`` hold columns, values and label."""
    z, n = np.zeros((columns + 1, classes)), np.zeros((columns + 1, classes))

    def solve(at: np.ndarray | slice) -> np.ndarray:
        zs, penalty = z[at], np.full((len(z[at]), 1), l1)
        if not isinstance(at, slice):
            penalty[-1] = 0.0  # the bias carries none
        return np.where(np.abs(zs) > penalty, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, columns), np.append(value, 1.0)
            w = solve(at)
            g = softmax(value @ w)
            g[label] -= 1.0
            g = value[:, None] * g[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solve(slice(None))
    return w[:-1].astype(np.float32), solve(np.array([columns]))[0]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows kept from fitting."""
    if not len(labels):
        return 1.0
    best, slack = (np.inf, 1.0), 1 / (len(labels) + 2)  # so that rows told apart without an error don't ask for certainty
    for t in np.geomspace(0.02, 5.0, 80):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(x).sum(axis=1)) - (1 - slack) * x[np.arange(len(labels)), labels] - slack * x.mean(axis=1)).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn every language of ``docs(doc_id, text, lang)``; rows without a language or a letter teach nothing.

    Document frequencies come from all rows; the weights from about
    ``sample`` rows, shared evenly by the languages and chosen by a hash
    of id and text, but from one of each language at least, and from
    ``ENTRIES`` columns of them together at most. None if no language is
    left. Rows that repeat count as often; other columns are not read.
    """
    ready(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("language"), "doc_id", "text").alias("chance"))
    lettered = docs.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    seen = lettered.groupBy("lang").agg(F.count("*").alias("count"), F.min("chance").alias("least")).collect()  # a row for each language
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return None
    bits = bits_for(len(languages))
    columns = 1 << bits
    # the hashes up to a share of their range, and the least in any case
    most = {r["lang"]: max(r["least"], int((min(1.0, sample / len(languages) / r["count"]) - 0.5) * 2.0**64)) for r in seen}
    number = {lang: k for k, lang in enumerate(languages)}
    schema = pa.schema([("label", pa.int32()), ("chance", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (-1, ..) of document frequencies for each task, and a row for each sampled document."""
        df, rows = np.zeros(columns + 1, np.int64), 0
        for batch in batches:
            out: list[tuple] = []
            for text, lang, chance in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = counts(text, bits)
                if found is None:
                    continue
                df[:-1] += found > 0
                rows += 1
                if chance <= most.get(lang, -(1 << 63)):
                    at = np.flatnonzero(found)
                    out.append((number[lang], chance, at.astype("<u2").tobytes(), found[at].astype("<u4").tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([at.astype("<u4").tobytes()]), pa.array([df[at].astype("<u8").tobytes()])], schema=schema)

    found = written(docs.mapInArrow(run, "label int, chance long, at binary, n binary"), "ngrams")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(columns + 1, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u8").astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["at", "n"])

    df = np.zeros(columns + 1, np.int64)
    sums = found.where("label = -1").select("at", "n").mapInArrow(add, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a row for each column at most
    df[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    entries = 0
    for r in found.where("label >= 0").orderBy(F.xxhash64("chance"), "label", "at", "n").toLocalIterator():
        entries += len(r["at"]) // 2
        if entries > ENTRIES and rows:
            break
        rows.append((r["label"], np.frombuffer(r["at"], "<u2"), features_of(r["at"], r["n"], idf)))
    if not rows:
        return None
    order = np.random.default_rng(7).permutation(len(rows))
    rows = [rows[i] for i in order]
    met = [0] * len(languages)
    fitted, kept = [], []
    for label, at, v in rows:  # of each language every fifth is kept from fitting
        met[label] += 1
        (kept if met[label] % 5 == 0 else fitted).append((at.astype(np.int64), v, label))
    weights, bias = ftrl(fitted, len(languages), columns)
    logits = np.array([v @ weights[at] + bias for at, v, _ in kept]).reshape(len(kept), len(languages))
    return Model(languages, idf, weights, bias, temperature(logits, np.array([label for _, _, label in kept], np.int64)), bits)


def features_of(at: bytes, n: bytes, idf: np.ndarray) -> np.ndarray:
    value = np.sqrt(np.frombuffer(n, "<u4")) * idf[np.frombuffer(at, "<u2")]
    norm = np.sqrt((value * value).sum())
    return (value / norm if norm else value).astype(np.float32)


def predict(docs: DataFrame, model: Model | None, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of docs, and language and score under the names given, a row for each row.

    A text that is null or has no letter gets ``und`` with score 0, as
    does every text if there is no model. Repeated rows each get a row; an
    empty table gives none. The names must not be among ``keep``.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**WEIGHT_BITS numbers, or 2**LEAST_BITS for each language
    fields = [docs.schema[c] for c in keep]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"`{lang}` string, `{score}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(len(keep)).to_pylist():
                found = counts(text, model.bits) if model else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(*features(found, model.idf))
                k = int(p.argmax())
                langs.append(model.languages[k])
                scores.append(min(1.0, float(p[k])))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang, score])

    return docs.select(*keep, F.col("text").alias(fresh(keep, "text"))).mapInArrow(run, ddl)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang)`` to (doc_id, held_out, lang_pred, score), a row for each row.

    Learns from the documents that are not held out: their texts and
    non-null languages, as in ``fit``; predicts all, as in ``predict``.
    A null id is not held out. Other columns are not read; an empty table
    gives no rows.
    """
    model = fit(docs.where(~held_out()), sample)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Documents whose language is told with a score of ``least`` at least, with all their columns.

    Null texts and those without a letter go; rows that repeat stay each;
    ids are not read but to hold some documents out of learning, and any
    other columns pass through whatever their names. With no language to
    learn from, no document is told and none stays.
    """
    model = fit(docs.where(~held_out()), sample)
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    told = predict(docs, model, docs.columns, lang, score)
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(docs.columns)
