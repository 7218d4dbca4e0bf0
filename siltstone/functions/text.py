"""Text expressions: cleaning, words, hashes, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(text: Column | str) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def clipped(text: Column | str, most: int) -> Column:
    """Collapsed text of at most ``most`` characters, an ellipsis in place of what is cut."""
    clean = collapse(text)
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…"))).otherwise(clean)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the collapsed, lower-cased text."""
    return F.sha2(F.lower(collapse(text)), 256)


def digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts with a bar between them, in hex."""
    return F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256)


def hash60(hexed: Column) -> Column:
    """The first 15 hex digits as a long, the same number in any engine."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def share(text: Column | str, pattern: str) -> Column:
    """Characters that match a one-character pattern, as a share of all; 0 for an empty text."""
    return F.coalesce(F.try_divide(F.regexp_count(col(text), F.lit(pattern)), F.length(col(text))), F.lit(0.0))


def ngrams(array: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces; none if there are fewer words."""
    starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " ")))


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    chain = F
    for rule, name in rules:
        chain = chain.when(rule, F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def plain(text: Column | str) -> Column:
    """Benchmark normalisation without compatibility folding: lower case, marks to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[\p{P}\p{S}\p{Z}\s]+", " "))
