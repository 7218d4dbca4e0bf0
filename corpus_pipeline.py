"""The corpus pipeline: documents to packed sequences.

``run`` applies the stages to the whole table of documents; each stage's
result is written to the shared workspace and reread as the next one's.
All stages but the last give back the columns of documents, whatever
others there are and whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontam, langid, linededup, packing, simhash
from siltstone.llm.common import ready, table
from siltstone.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of 0.3 at least stay; others, among them null and empty texts and those without a letter, go.

    Rows that repeat, or have no id, are judged each by their own text.
    """
    ready(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, up to two edits from ten words or forty characters on, and documents of nothing else.

    Null and empty texts stay; of rows equal in id and text one stays;
    rows that share an id, or have none, are told apart by their texts.
    """
    ready(spark)
    return linededup.drop_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts without words are copies of one another; of rows that share an
    id one stays; rows without an id stay, as nothing names them.
    """
    ready(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands, also with other numbers, names or units, go.

    Each row is judged by its own text, whatever its id; null and empty
    texts stay, and so do all documents where the benchmark is empty.
    """
    ready(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in windows of 2048 tokens that keep the sources' shares: a row for each piece of a document.

    A null text counts as empty, which is the end id alone, and a null
    source as the empty name; rows that repeat are packed each.
    """
    ready(spark)
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: Fitted models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the packed pieces."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
