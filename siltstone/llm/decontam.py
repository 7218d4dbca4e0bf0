"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Numbers, names and units become typed placeholders, so that a question
with other values has the same template. Windows of template words are
hashed and joined with the benchmark's windows; matches on one diagonal
(same distance between the two places) belong to one instance of an item.
A value of the item for which two values of the document stand is a
clash: windows that hold it count only where they are verbatim. Windows
of mostly placeholders, and items shorter than a window, are matched by
their words and values as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import written

#: Template words of a window, those of them that must not be placeholders, and windows of an instance (or all that the item has).
WINDOW, LITERAL, LEAST = 8, 4, 6
#: Items that may share a window before it is looked up only where another window of the item was found.
SHARED = 64
#: Windows of the benchmark up to which its side of the join is sent to every task (16 bytes each and the slots).
SENT = 2_000_000
# Words that count as units after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches feet foot yard yards mile miles meter meters metre metres kilometers kilometres "
    "mg g kg lb lbs oz ton tons tonne tonnes gram grams kilogram kilograms pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons cup cups s sec min h hr hrs second seconds minute minutes hour hours "
    "day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degrees mph kmh hz khz mhz ghz "
    "kb mb gb tb w kw kwh v kv a j kj n pa mol"
).split()


def tokens(text: Column) -> Column:
    """Lower-case words and numbers of a text; slots carry a mark, a type (n, a or u) and their value.

    A name is a capitalised word that follows a word or comma on its
    line; digits joined by a point, comma, colon or slash are one number.
    """
    t = F.translate(text, "§", " ")
    t = F.regexp_replace(t, r"(?<=\p{N})[.,:/](?=\p{N})", "")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;)] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "§a$1")
    t = F.regexp_replace(t, r"\p{N}+", " §n$0 ")
    t = F.lower(t)
    t = F.regexp_replace(t, rf"(§n\p{{N}}+ +)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", "$1§u$2")
    return F.array_remove(F.split(t, r"[^\p{L}\p{N}§]+"), "")


def template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith("§"), F.substring(w, 1, 2)).otherwise(w))


def literal(words: Column) -> Column:
    """The words without the marks of slots, so that a name at the start of a line is the same word."""
    return F.transform(words, lambda w: F.when(w.startswith("§"), F.substring(w, 3, 1 << 20)).otherwise(w))


def run_hash(plain: Column, at: Column, length: int) -> Column:
    """Of words as they stand; apart from the hashes of templates."""
    return F.xxhash64(F.lit("literal"), F.slice(plain, at + 1, length))


def runs(plain: Column, length: int) -> Column:
    """The place and hash of each run of so many words."""
    return F.transform(places(plain, length), lambda i: F.struct(i.alias("at"), run_hash(plain, i, length).alias("w")))


def places(words: Column, window: int) -> Column:
    """The starts of all windows, from 0."""
    return F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))


def slots(words: Column, at: Column, window: int) -> Column:
    return F.filter(F.slice(words, at + 1, window), lambda w: w.startswith("§"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``benchmark(item_id, text)`` to ``(w, length, item_id, item_at, item_slots, need, need_all, late)``: its windows.

    A window of enough plain words is hashed as a template, with length
    null. Others are hashed as they stand, with their length and no
    slots: those of mostly placeholders, and all words of an item that is
    shorter than a window. ``need`` is how many template windows an
    instance must match, 0 if the item has none, or else ``need_all``
    windows of both kinds. A window that many items share is ``late``
    where the item can't match by such windows alone: it is asked for
    once another window of the item was found.
    """
    items = written(benchmark.where("text is not null").select("item_id", tokens(F.col("text")).alias("words")), "items")
    items = items.select("item_id", "words", template(F.col("words")).alias("plain"), literal(F.col("words")).alias("bare"))
    found = items.select("item_id", "words", "plain", "bare", F.explode_outer(places(F.col("words"), window)).alias("item_at")).where("item_at is not null")
    found = found.withColumn("item_slots", slots(F.col("words"), F.col("item_at"), window))
    enough = F.size("item_slots") <= window - LITERAL
    plain = found.where(enough).select(F.xxhash64(F.slice("plain", F.col("item_at") + 1, window)).alias("w"), F.lit(None).cast("int").alias("length"), "item_id", "item_at", "item_slots")
    none = F.array().cast("array<string>").alias("item_slots")
    heavy = found.where(~enough).select(run_hash(F.col("bare"), F.col("item_at"), window).alias("w"), F.lit(window).alias("length"), "item_id", "item_at", none)
    short = items.where((F.size("words") > 0) & (F.size("words") < window))
    short = short.select(F.xxhash64(F.lit("literal"), "bare").alias("w"), F.size("bare").alias("length"), "item_id", F.lit(0).alias("item_at"), none)
    found = written(plain.unionByName(heavy).unionByName(short).distinct(), "items")
    at = F.when(F.col("length").isNull(), F.col("item_at"))
    need = found.groupBy("item_id").agg(F.least(F.lit(LEAST), F.countDistinct(at)).alias("need"), F.least(F.lit(LEAST), F.countDistinct("item_at")).alias("need_all"))
    shared = found.groupBy("w").agg(F.countDistinct("item_id").alias("items")).where(F.col("items") > SHARED).select("w", F.lit(True).alias("shared"))
    found = found.join(need, "item_id").join(shared, "w", "left")
    by_shared = found.where("shared").groupBy("item_id").agg(F.countDistinct("item_at").alias("by_shared"))
    found = found.join(by_shared, "item_id", "left")
    least = F.least(F.col("need_all"), F.when(F.col("need") > 0, F.col("need")).otherwise(F.col("need_all")))
    late = F.coalesce(F.col("shared") & (F.col("by_shared") < least), F.lit(False))
    return written(found.withColumn("late", late).drop("shared", "by_shared"), "items")


def rows_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, text)``, ``row`` being the text's hash, which tells rows of one id apart; null texts go."""
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["row"] == right["row"])


def spots_of(docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """``(doc_id, row, at, w)``: every template window of every text, and every run of words as they stand of these lengths."""
    words = rows_of(docs).select("doc_id", "row", template(tokens(F.col("text"))).alias("plain"))
    hashed = words.select("doc_id", "row", F.transform(places(F.col("plain"), window), lambda i: F.xxhash64(F.slice("plain", i + 1, window))).alias("hashes"))
    # the outer form: for the inner one a filter on the array is inferred, and hashing would run twice
    spots = hashed.select("doc_id", "row", F.posexplode_outer("hashes").alias("at", "w")).where("w is not null")
    if not lengths:
        return spots
    bare = rows_of(docs).select("doc_id", "row", literal(tokens(F.col("text"))).alias("bare"))
    more = bare.select("doc_id", "row", F.concat(*(runs(F.col("bare"), n) for n in lengths)).alias("runs"))
    return spots.unionByName(more.select("doc_id", "row", F.explode_outer("runs").alias("r")).where("r is not null").select("doc_id", "row", "r.at", "r.w"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, row, item_id, windows, slots)``: as ``matches``, for each text."""
    items = item_windows(benchmark.select("item_id", "text"), window)
    side = lambda df: F.broadcast(df) if df.count() <= SENT else df  # noqa: E731  beyond, a shuffled join
    lengths = sorted(r["length"] for r in items.where("length is not null").select("length").distinct().collect())  # a window's at most
    columns = ["doc_id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "at", "item_at", "item_slots", "length", "need", "need_all"]
    hits = written(spots_of(docs, window, lengths).join(side(items.where("not late")), "w").select(*columns), "hits")
    late = items.where("late")
    if not late.isEmpty():
        pairs = written(hits.select("doc_id", "row", "item_id").distinct(), "pairs")
        texts = pairs.select("doc_id", "row").distinct()
        asked = docs.join(texts, docs["doc_id"].eqNullSafe(texts["doc_id"]) & (F.xxhash64(docs["text"]) == texts["row"]), "left_semi")
        wanted = pairs.join(late, "item_id")
        spots = spots_of(asked, window, lengths)
        on = same_row(spots, wanted) & (spots["w"] == wanted["w"])
        more = spots.join(wanted, on).select(spots["doc_id"], spots["row"], "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "at", "item_at", "item_slots", "length", "need", "need_all")
        hits = written(hits.unionByName(more), "hits")
    bad = clashes(docs, hits.where(F.size("item_slots") > 0), window)
    at = ["item_id", "diagonal", "item_at"]
    good = hits.join(bad, same_row(hits, bad) & _all_equal(hits, bad, at), "left_anti")
    plain = F.when(F.col("length").isNull(), F.col("item_at"))
    found = good.groupBy("doc_id", "row", "item_id").agg(F.countDistinct(plain).alias("plain"), F.countDistinct("item_at").alias("windows"), F.max("need").alias("need"), F.max("need_all").alias("need_all"), F.max(F.size("item_slots")).alias("slots"))
    return found.where("(need > 0 and plain >= need) or windows >= need_all").select("doc_id", "row", "item_id", "windows", "slots")


def _all_equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Whether these columns, which may be null, are the same on both sides."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` against ``benchmark(item_id, text)``: (doc_id, item_id, windows, slots) of each leaked item.

    ``windows`` counts the item's windows that stand in the document
    without a clash or verbatim, ``slots`` the most slots of one of them.
    Null texts match nothing, nor do items without a word. Each text is
    matched by itself; of rows that share an id, or have none, the most
    windows and slots are given, once for each item. Empty tables give no
    rows; other columns are not read.
    """
    return leaks(docs, benchmark, window).groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("slots").alias("slots"))


def clashes(docs: DataFrame, slotted: DataFrame, window: int) -> DataFrame:
    """The windows (doc_id, row, item_id, diagonal, item_at) with a value of the item for which two of the document stand in the instance, but for verbatim ones."""
    rows = rows_of(docs)
    wanted = slotted.select("doc_id", "row", "at").distinct().groupBy("doc_id", "row").agg(F.collect_set("at").alias("ats"))
    asked = rows.join(wanted, same_row(rows, wanted)).select(rows["doc_id"], rows["row"], "text", "ats").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", tokens(F.col("text")).alias("words"), "ats")
    values = asked.select("doc_id", "row", "words", F.explode("ats").alias("at")).select("doc_id", "row", "at", slots(F.col("words"), F.col("at"), window).alias("doc_slots"))
    instance = ["doc_id", "row", "item_id", "diagonal"]
    same = F.col("item_slots") == F.col("doc_slots")
    joined = slotted.join(values, same_row(slotted, values) & (slotted["at"] == values["at"]))
    pairs = joined.select(*(slotted[c] for c in instance), "item_at", same.alias("same"), F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("p"))
    pairs = written(pairs.select(*instance, "item_at", "same", F.col("p.item_slots").alias("x"), F.col("p.doc_slots").alias("y")), "slots")
    two = pairs.groupBy(*instance, "x").agg(F.min("y").alias("least"), F.max("y").alias("most")).where("least <> most").select(*instance, "x")
    held = pairs.join(two, _all_equal(pairs, two, [*instance, "x"]), "left_semi")
    return held.groupBy(*instance, "item_at").agg(F.max("same").alias("same")).where("not same").drop("same")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents in which no item leaked, with all their columns.

    Each row is judged by its own text, whatever its id; null and empty
    texts stay, rows that repeat stay or go together, and an empty
    benchmark leaves all. An empty table gives no rows.
    """
    leaked = leaks(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "row").distinct()
    own = docs["doc_id"].eqNullSafe(leaked["doc_id"]) & (F.xxhash64(docs["text"]) == leaked["row"])
    return docs.join(leaked, own, "left_anti").select(docs.columns)
