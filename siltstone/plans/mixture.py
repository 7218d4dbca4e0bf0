"""Mixture, token accounting, packing arrays, evaluation metrics (survey 2.L and 2.M)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators import relational as R
from siltstone.registry import Tables, query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
#: Predictions stand in for a model: the label by a rule on the id.
PAIRS = "(SELECT doc_id, toxic AS y, CASE WHEN doc_id % 9 = 0 THEN 1 - toxic WHEN doc_id % 31 = 0 THEN -1 ELSE toxic END AS p FROM labels)"


def _pairs(t: Tables) -> DataFrame:
    p = F.when(F.col("doc_id") % 9 == 0, 1 - F.col("toxic")).when(F.col("doc_id") % 31 == 0, -1).otherwise(F.col("toxic"))
    return t.labels.select("doc_id", F.col("toxic").alias("y"), p.alias("p"))


@query("""
WITH t AS (SELECT lang, source, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars // 4 END AS tok FROM documents)
SELECT lang, count(*) AS n, sum(tok)::BIGINT AS known, CASE WHEN count(tok) = count(*) THEN 'exact' WHEN count(tok) > 0 THEN 'probe' ELSE 'unavailable' END AS method,
  round(avg(tok) * count(*), 4) AS estimate FROM t GROUP BY lang
""")
def token_totals(t: Tables) -> DataFrame:
    """Missing counts are unknown, not zero: they turn the method to an estimate."""
    tok = F.when(F.col("doc_id") % 17 != 0, F.floor(F.col("n_chars") / 4))
    method = T.first_rule([(F.count("tok") == F.count("*"), "exact"), (F.count("tok") > 0, "probe")], "unavailable")
    return t.documents.select("lang", tok.alias("tok")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("tok").alias("known"), method.alias("method"), F.round(F.avg("tok") * F.count("*"), 4).alias("estimate"))


@query("""
WITH r AS (SELECT source, n_chars // 8 AS inst, n_chars // 4 AS resp FROM documents)
SELECT source, count(*) AS n, sum((resp > 1024 - least(inst, 1024))::INT)::BIGINT AS truncated, sum(least(resp, 1024 - least(inst, 1024)))::BIGINT AS effective FROM r GROUP BY source
""")
def context_fit(t: Tables) -> DataFrame:
    inst, resp = F.floor(F.col("n_chars") / 8), F.floor(F.col("n_chars") / 4)
    room = 1024 - F.least(inst, F.lit(1024))
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(resp > room).alias("truncated"), F.sum(F.least(resp, room)).alias("effective"))


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256('pick|' || doc_id)) - 1 AS rn FROM documents),
o AS (SELECT *, rn // 10 AS pass, sum(n_chars) OVER (ORDER BY rn // 10, source, rn) AS cum FROM r)
SELECT doc_id, pass FROM o WHERE cum - n_chars < 500000
""")
def token_target_select(t: Tables) -> DataFrame:
    """Passes of ten rows a source until the target; passes are summed before rows are, and only those at the target are opened."""
    r = t.documents.select("source", "doc_id", "n_chars", T.digest(F.lit("pick"), "doc_id").alias("h"))
    r = R.prefix(r, ["source"], ["h"], R.by_digits("h"), F.lit(1), "rn").withColumn("pass", F.floor(F.col("rn") / 10))
    sums = r.groupBy("pass").agg(F.sum("n_chars").alias("s"))
    base = sums.select("pass", F.coalesce(F.sum("s").over(Window.orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")).where("base < 500000")
    inside = F.sum("n_chars").over(Window.partitionBy("pass").orderBy("source", "rn"))
    return r.join(base, "pass").withColumn("cum", F.col("base") + inside).where(F.col("cum") - F.col("n_chars") < 500000).select("doc_id", "pass")


@query("SELECT doc_id, k AS chunk, least(2000, n_chars - k * 2000) AS len FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 1999) // 2000)) AS k FROM documents)")
def response_chunks(t: Tables) -> DataFrame:
    n = F.floor((F.col("n_chars") + 1999) / 2000)
    k = t.documents.where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return k.select("doc_id", "chunk", F.least(F.lit(2000).cast("long"), F.col("n_chars") - F.col("chunk") * 2000).alias("len"))


@query("""
WITH u AS (SELECT doc_id, doc_id * 10 AS pointer, 'base' AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, doc_id * 10 + 1000000, 'addition' FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, pointer, part, ('0x' || substr(sha256('epoch|' || doc_id), 1, 15))::BIGINT AS place FROM u
""")
def epoch_merge(t: Tables) -> DataFrame:
    """Base and additions with moved pointers; ``place`` orders the epoch."""
    add = F.col("doc_id") % 2 == 1
    return t.documents.select(
        "doc_id", (F.col("doc_id") * 10 + F.when(add, 1000000).otherwise(0)).alias("pointer"), F.when(add, "addition").otherwise("base").alias("part"), T.hash60(T.digest(F.lit("epoch"), "doc_id")).alias("place")
    )


@query("SELECT source, r AS copy, count(*) AS n FROM (SELECT source, unnest(range(1, CASE WHEN source IN ('src1', 'src2') THEN 4 ELSE 2 END)) AS r FROM documents) GROUP BY 1, 2")
def repeat_expand(t: Tables) -> DataFrame:
    times = F.when(F.col("source").isin("src1", "src2"), 3).otherwise(1)
    return t.documents.select("source", F.explode(F.sequence(F.lit(1), times)).alias("copy")).groupBy("source", "copy").agg(F.count("*").alias("n"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(w) // 3 AS k FROM w)
SELECT doc_id, array_to_string(list_transform(w, lambda x: length(x)), ',') AS inputs,
  array_to_string(list_concat(list_transform(range(0, k), lambda i: -100), list_transform(w[k + 1:], lambda x: length(x))), ',') AS labels, array_to_string(range(0, len(w)), ',') AS positions FROM s
""")
def prefixlm_arrays(t: Tables) -> DataFrame:
    """Word lengths stand for token ids; the first third is the instruction."""
    s = t.documents.select("doc_id", T.words("text").alias("w")).withColumn("ids", F.transform("w", lambda x: F.length(x))).withColumn("k", F.floor(F.size("w") / 3).cast("int"))
    labels = F.transform("ids", lambda x, i: F.when(i < F.col("k"), -100).otherwise(x))
    positions = F.transform("ids", lambda x, i: i)
    return s.select("doc_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in (("ids", "inputs"), (labels, "labels"), (positions, "positions"))))


@query("""
WITH b AS (SELECT sum(n_chars) AS total FROM documents WHERE lang = 'en')
SELECT lang, sum(n_chars)::BIGINT AS chars, least(sum(n_chars), floor(max(total) * 0.15))::BIGINT AS cap FROM documents CROSS JOIN b WHERE lang <> 'en' GROUP BY lang
""")
def pair_caps(t: Tables) -> DataFrame:
    total = t.documents.where("lang = 'en'").agg(F.sum("n_chars").alias("total"))  # one row
    g = t.documents.where("lang <> 'en'").groupBy("lang").agg(F.sum("n_chars").alias("chars")).crossJoin(F.broadcast(total))
    return g.select("lang", "chars", F.least("chars", F.floor(F.col("total") * 0.15)).alias("cap"))


def largest_batch(lengths: np.ndarray, bins: int, size: int) -> list[list[int]] | None:
    """The largest prefix of the lengths that longest-first packing puts into ``bins`` of ``size``; None if not even one row a bin fits."""

    def fits(n: int) -> list[list[int]] | None:
        room, rows = [size] * bins, [[] for _ in range(bins)]
        for k in np.argsort(-lengths[:n], kind="stable"):
            b = int(np.argmax(room))
            if room[b] < lengths[k]:
                return None
            room[b] -= int(lengths[k])
            rows[b].append(int(k))
        return rows

    lo, hi = 1, min(len(lengths), int(np.searchsorted(np.cumsum(lengths), bins * size, "right")))
    best = None
    while lo <= hi:
        mid = (lo + hi) // 2
        got = fits(mid)
        best, lo, hi = (got, mid + 1, hi) if got else (best, lo, mid - 1)
    return best if best and sum(map(len, best)) >= bins else None


@query(None)
def multipack(t: Tables) -> DataFrame:
    """Batches of contiguous rows in 4 bins of 8192 tokens; shards of 4096 ids are packed apart, so no task sees all rows."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        ids, lengths = rows["doc_id"].to_numpy(), np.minimum(rows["n"].to_numpy(), 8192)
        out, at, batch = [], 0, 0
        while at < len(ids):
            found = largest_batch(lengths[at:], 4, 8192)
            if not found:  # fewer rows than bins are left: a last batch, a row in each bin
                found = [[k] for k in range(len(ids) - at)]
            out += [(rows["shard"].iloc[0], batch, b, ids[at + k], lengths[at + k]) for b, own in enumerate(found) for k in own]
            at, batch = at + sum(map(len, found)), batch + 1
        return pd.DataFrame(out, columns=["shard", "batch", "bin", "doc_id", "n"])

    d = t.documents.select(F.floor(F.col("doc_id") / 4096).alias("shard"), "doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("n"))
    return d.groupBy("shard").applyInPandas(pack, "shard long, batch long, bin long, doc_id long, n long")


@query(f"SELECT round(avg(CASE WHEN p = y THEN 1.0 WHEN p = -1 THEN 0.5 ELSE 0 END), 6) AS partial, round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 6) AS strict, round(avg((p = -1)::INT), 6) AS invalid FROM {PAIRS}")
def accuracy(t: Tables) -> DataFrame:
    same, odd = F.col("p") == F.col("y"), F.col("p") == -1
    return _pairs(t).agg(F.round(F.avg(F.when(same, 1.0).when(odd, 0.5).otherwise(0.0)), 6).alias("partial"), F.round(F.avg(same.cast("double")), 6).alias("strict"), F.round(F.avg(odd.cast("double")), 6).alias("invalid"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) ELSE 0 END, 6) AS stderr FROM events GROUP BY 1")
def mean_stderr(t: Tables) -> DataFrame:
    e = F.when(F.count("*") > 1, F.stddev_samp("value") / F.sqrt(F.count("*"))).otherwise(0.0)
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(e, 6).alias("stderr"))


@query(f"""
WITH l AS (SELECT unnest([0, 1]) AS k), c AS (SELECT k, sum((p = k AND y = k)::INT) AS tp, sum((p = k AND y <> k)::INT) AS fp, sum((p <> k AND y = k)::INT) AS fn FROM l CROSS JOIN {PAIRS} GROUP BY k)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM c
""")
def macro_f1(t: Tables) -> DataFrame:
    p = _pairs(t).agg(*(F.count_if(cond).alias(f"{n}{k}") for k in (0, 1) for n, cond in (("tp", (F.col("p") == k) & (F.col("y") == k)), ("fp", (F.col("p") == k) & (F.col("y") != k)), ("fn", (F.col("p") != k) & (F.col("y") == k)))))
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"tp{k}"), 2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}")), F.lit(0.0)) for k in (0, 1)]
    return p.select(F.round((f1[0] + f1[1]) / 2, 6).alias("macro_f1"))


@query(f"""
WITH c AS (SELECT y, p, count(*) AS n FROM {PAIRS} GROUP BY 1, 2), s AS (SELECT sum(n) AS s, sum(CASE WHEN y = p THEN n ELSE 0 END) AS c FROM c),
t AS (SELECT sum(ty * tp) AS tp, sum(ty * ty) AS tt, sum(tp * tp) AS pp FROM (SELECT k, sum(CASE WHEN y = k THEN n ELSE 0 END) AS ty, sum(CASE WHEN p = k THEN n ELSE 0 END) AS tp FROM c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) GROUP BY k))
SELECT round((c * s - tp) / sqrt((s * s - pp)::DOUBLE * (s * s - tt)), 6) AS mcc FROM s CROSS JOIN t
""")
def mcc(t: Tables) -> DataFrame:
    c = _pairs(t).groupBy("y", "p").agg(F.count("*").cast("double").alias("n"))
    keys = (-1, 0, 1)
    of = lambda col, k: F.sum(F.when(F.col(col) == k, F.col("n")).otherwise(0.0))
    sums = c.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"), *(of(col, k).alias(f"{col}{i}") for col in "yp" for i, k in enumerate(keys)))
    dot = lambda a, b: sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(3)), F.lit(0.0))
    s2 = F.col("s") * F.col("s")
    return sums.select(F.round((F.col("c") * F.col("s") - dot("y", "p")) / F.sqrt((s2 - dot("p", "p")) * (s2 - dot("y", "y"))), 6).alias("mcc"))


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS rn, sum(n) OVER (PARTITION BY l_orderkey) AS total FROM v)
SELECT l_returnflag AS winner, count(*) AS n, round(avg(n / total), 6) AS support FROM r WHERE rn = 1 GROUP BY 1
""")
def majority_vote(t: Tables) -> DataFrame:
    v = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    w = v.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("n", -F.ascii("l_returnflag"))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("total"))
    return w.groupBy("winner").agg(F.count("*").alias("n"), F.round(F.avg(F.col("top") / F.col("total")), 6).alias("support"))


@query(f"""
WITH p AS (SELECT conv_id, turn, {WORDS} AS a, lag({WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT *, least(len(a), len(b)) AS n FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, coalesce(list_position(list_transform(range(1, n + 1), lambda i: a[i] = b[i]), false) - 1, n)::BIGINT AS lcp, (n = len(a) AND n = len(b) AND list_position(list_transform(range(1, n + 1), lambda i: a[i] = b[i]), false) IS NULL) AS exact FROM q
""")
def lcp(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = t.conversations.select("conv_id", "turn", T.words("text").alias("a"), F.lag("text").over(w).alias("before")).where("before is not null").withColumn("b", T.words("before"))
    n = F.least(F.size("a"), F.size("b"))
    differs = F.array_position(F.transform(F.slice(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(1), n), lambda x: x.cast("int")), 0)
    return q.select("conv_id", "turn", F.when(differs > 0, differs - 1).otherwise(n.cast("long")).alias("lcp"), ((differs == 0) & (F.size("a") == F.size("b"))).alias("exact"))


WILSON = "(({p} + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt({p} * (1 - {p}) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n))"


@query(f"""
WITH g AS (SELECT source, count(*) AS n, sum(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round({WILSON.format(p='(s / n)', sign='-')}, 6) AS low, round({WILSON.format(p='(s / n)', sign='+')}, 6) AS high FROM g
""")
def wilson(t: Tables) -> DataFrame:
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), (F.sum("quality") / F.count("*")).alias("p"))
    z2, n, p = 1.96 * 1.96, F.col("n"), F.col("p")
    half = 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    bound = lambda sign: F.round((p + z2 / (2 * n) + sign * half) / (1 + z2 / n), 6)
    return g.select("source", bound(-1).alias("low"), bound(1).alias("high"))


@query(None)
def bootstrap_ci(t: Tables) -> DataFrame:
    """Poisson bootstrap: each row has a hashed weight in each of 200 draws, so draws are sums and rows never move."""
    draws = 200
    # the weight's quantiles are those of a Poisson variable of mean 1
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    draw = t.events.select("event_type", "value", "event_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k")).withColumn("w", _weight(cuts))
    means = draw.groupBy("event_type", "k").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("m"))
    return means.groupBy("event_type").agg(F.avg("m").alias("mean"), (F.avg("m") - 1.96 * F.stddev_samp("m")).alias("low"), (F.avg("m") + 1.96 * F.stddev_samp("m")).alias("high"))


def _weight(cuts: list[float]):
    u = F.pmod(F.xxhash64("k", "event_id"), F.lit(1 << 24)) / float(1 << 24)
    return sum(((u >= c).cast("int") for c in cuts), F.lit(0))


@query(None)
def block_bootstrap(t: Tables) -> DataFrame:
    """Circular moving blocks over daily means: percentile interval of each series' mean."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("day")["v"].to_numpy()
        rng, block = np.random.default_rng(7), min(5, len(v))
        starts = rng.integers(0, len(v), (1000, -(-len(v) // block)))
        at = (starts[:, :, None] + np.arange(block)) % len(v)
        means = v[at.reshape(1000, -1)[:, : len(v)]].mean(axis=1)
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"event_type": [rows["event_type"].iloc[0]], "mean": [v.mean()], "low": [lo], "high": [hi]})

    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))  # a row for each day
    return daily.groupBy("event_type").applyInPandas(draw, "event_type string, mean double, low double, high double")


@query("""
WITH p AS (SELECT source, 1.0 / (1 + count(*)) AS p FROM documents GROUP BY source), r AS (SELECT source, p, row_number() OVER (ORDER BY p, source) - 1 AS k, count(*) OVER () AS m FROM p)
SELECT source, round(max(least(1.0, (m - k) * p)) OVER (ORDER BY p, source), 9) AS adjusted FROM r
""")
def holm(t: Tables) -> DataFrame:
    """One p-value for each source stands in; there are few."""
    p = t.documents.groupBy("source").agg((1.0 / (1 + F.count("*"))).alias("p"))
    w = Window.orderBy("p", "source")
    r = p.withColumn("k", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy()))
    return r.select("source", F.round(F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k")) * F.col("p"))).over(w), 9).alias("adjusted"))


@query("SELECT event_type, round(regr_slope(value, event_id) * 10000, 5) AS slope_per_10k FROM events GROUP BY 1")
def trend_slope(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.regr_slope("value", "event_id") * 10000, 5).alias("slope_per_10k"))


@query(f"""
WITH p AS (SELECT conv_id, turn, list_distinct({WORDS}) AS a, list_distinct(lag({WORDS}) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS f1 FROM p WHERE b IS NOT NULL
""")
def unigram_f1(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = t.conversations.select("conv_id", "turn", F.array_distinct(T.words("text")).alias("a"), F.lag("text").over(w).alias("before")).where("before is not null").withColumn("b", F.array_distinct(T.words("before")))
    return q.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")), F.lit(0.0)), 6).alias("f1"))
