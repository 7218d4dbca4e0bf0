"""Queries whose operator no built-in expression says: vectorized functions, and the article filter beside them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.registry import Tables, query
from siltstone.session import ship


@query(r"""
WITH p AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '^(Licensed|All rights|Released|This work)')), chr(10)) AS body FROM documents)
SELECT doc_id, length(body)::BIGINT AS chars, length(body) BETWEEN 900 AND 12000 AND NOT regexp_matches(lower(body), 'token =|password')
  AND len(regexp_extract_all(body, '[A-Za-zÀ-ɏ]')) >= 0.8 * len(regexp_extract_all(body, '[\p{L}]')) AS kept FROM p
""")
def article_filter(t: Tables) -> DataFrame:
    """Boilerplate lines go; then length, topic and script decide."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) >= 20) & ~x.rlike("^(Licensed|All rights|Released|This work)"))
    p = t.documents.select("doc_id", F.array_join(lines, "\n").alias("body"))
    b = F.col("body")
    latin = F.regexp_count(b, F.lit("[A-Za-zÀ-ɏ]")) >= 0.8 * F.regexp_count(b, F.lit(r"[\p{L}]"))
    return p.select("doc_id", F.length(b).cast("long").alias("chars"), (F.length(b).between(900, 12000) & ~F.lower(b).rlike("token =|password") & latin).alias("kept"))


@query(None)
def unicode_normalize(t: Tables) -> DataFrame:
    """Compatibility composition, one kind of line end, full case folding."""
    ship(t.spark)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.replace("\r\n", "\n").replace("\r", "\n")).casefold())

    return t.documents.select("doc_id", fold("text").alias("normalized"))


# Pairs of letters that character recognition confuses.
CONFUSED = {("rn", "m"), ("m", "rn"), ("l", "1"), ("1", "l"), ("o", "0"), ("0", "o"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h")}


def equal_run(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] and b[j] on are the same."""
    n, step = 0, 1
    while step:
        if a[i + n : i + n + step] == b[j + n : j + n + step] and i + n + step <= len(a) and j + n + step <= len(b):
            n += step
            step *= 2
        else:
            step //= 2
    return n


def confusions(source: str, target: str, most: int = 8) -> int | None:
    """The least number of declared confusions that turn source into target; None if there is no such way within ``most``."""
    reached = {0: {0: 0}}  # place in source -> place in target -> edits
    while reached and (i := min(reached)) < len(source):
        at = reached.pop(i)
        if len(at) == 1:  # no confusion begins with one letter on both sides, so an equal run is passed at once
            ((j, n),) = at.items()
            run = equal_run(source, i, target, j)
            if run:
                reached.setdefault(i + run, {})[j + run] = min(reached.get(i + run, {}).get(j + run, most + 1), n)
                continue
        for j, n in sorted(at.items()):
            steps = [(1, 1, 0)] if i < len(source) and j < len(target) and source[i] == target[j] else []
            steps += [(len(a), len(b), 1) for a, b in CONFUSED if n < most and source.startswith(a, i) and target.startswith(b, j)]
            for di, dj, cost in steps:
                row = reached.setdefault(i + di, {})
                row[j + dj] = min(row.get(j + dj, most + 1), n + cost)
    return reached.get(len(source), {}).get(len(target))


@query(None)
def edit_contract(t: Tables) -> DataFrame:
    """Texts with a few letters confused on purpose are accepted if 1 to 8 declared confusions explain them."""
    ship(t.spark)
    text = F.col("text")
    d = t.documents.select("doc_id", text.alias("source"), F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, F.regexp_replace(text, "rn", "m")).otherwise(F.concat(text, F.lit("?"))).alias("target"))

    @F.pandas_udf("int")
    def edits(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([confusions(a or "", b or "") for a, b in zip(source, target, strict=True)], dtype="Int64").astype("float").astype("Int32")

    n = F.col("n")
    reason = F.when(n.isNull(), "undeclared").when(n == 0, "unchanged").otherwise("accepted")
    return d.select("doc_id", edits("source", "target").alias("n")).groupBy(reason.alias("reason")).agg(F.count("*").alias("rows_n"))


@query(None)
def token_fit(t: Tables) -> DataFrame:
    """Oldest whole turns go until the last answer and its history fit 512 words; the rendered prompt must be a prefix of the whole."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for conv_id, turns in zip(rows["conv_id"], rows["turns"], strict=True):
                turns = [(x["role"], x["text"].split()) for x in turns]
                last = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=None)
                if last is None or len(turns[last][1]) < 2:
                    continue
                first = 0
                while first < last and sum(len(w) + 1 for _, w in turns[first : last + 1]) > 512:
                    first += 1
                prompt = [x for role, w in turns[first:last] for x in [role, *w]] + ["assistant"]
                whole = prompt + turns[last][1]
                assert whole[: len(prompt)] == prompt
                out.append((conv_id, first, len(prompt), len(whole)))
            yield pd.DataFrame(out, columns=["conv_id", "dropped_turns", "prompt_words", "words"])

    ship(t.spark)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    return t.conversations.groupBy("conv_id").agg(turns).mapInPandas(fit, "conv_id long, dropped_turns long, prompt_words long, words long")
