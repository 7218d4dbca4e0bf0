"""Queries of the operators over the driver's tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, decontam, langid, linededup, packing, rans, secrets, simhash, toxicity, voronoi
from siltstone.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 3-word-shingle fingerprint and the group it falls in."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), words_in_shingle=3, distance=3)


@query
def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back: each document's place, length and checksum."""
    back = rans.round_trip(table(spark, sf_dir, "documents"), end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("segments"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, the class of near-equal lines it falls in, and whether it stays."""
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in which a benchmark item's template stands, with the item and how much of it."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens that keep the sources' shares: a row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1, with_ids=False)


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLES["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are no prefix of another, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op8_chat_formatting"] = r"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t
), c AS (
    SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
           md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h
    FROM p
), e AS (
    SELECT n, h, min(conv_id) AS conv_id, count(*) AS copies FROM c WHERE pos = n GROUP BY n, h
), k AS (
    SELECT conv_id, n, copies FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.pos = e.n AND c.h = e.h AND c.n > e.n)
)
SELECT p.conv_id, (p.pos - 1) // 256 AS part, max(k.n) AS turns, max(k.copies) AS copies,
       string_agg('<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10)
                  || replace(replace(text, '<|', '< |'), '|>', '| >') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM p JOIN k USING (conv_id) GROUP BY 1, 2
"""


@query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document and how likely it is one; the candidate itself only as a digest."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("digest", F.sha2("candidate", 256)).drop("candidate")
