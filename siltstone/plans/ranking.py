"""Windows, ranking, sampling and set operations (survey 2.F, 2.G, 2.H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators import relational as R
from siltstone.registry import Tables, query

UNIT = "(('0x' || substr(sha256({0}), 1, 15))::BIGINT / 1152921504606846976.0)"


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS seq FROM customer")
def row_number_partition(t: Tables) -> DataFrame:
    before = R.prefix(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"], R.by_value("c_custkey"), F.lit(1), "before")
    return before.select("c_mktsegment", "c_custkey", (F.col("before") + 1).alias("seq"))


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def latest_success(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("""
WITH c AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS cum FROM documents)
SELECT lang, count(*) AS n, max(cum)::BIGINT AS total FROM c WHERE cum - n_chars < 100000 GROUP BY lang
""")
def token_budget_prefix(t: Tables) -> DataFrame:
    c = R.prefix(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], ["doc_id"], R.by_value("doc_id"), F.col("n_chars"), "before")
    return c.where("before < 100000").groupBy("lang").agg(F.count("*").alias("n"), F.max(F.col("before") + F.col("n_chars")).alias("total"))


@query("""
WITH e AS (SELECT event_type, event_id, value, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events)
SELECT event_type, ceil(event_id / 1000.0)::BIGINT AS bucket, count(*) AS n, max(gap) AS max_gap, round(median(gap), 3) AS median_gap, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2
""")
def tumbling_window_stats(t: Tables) -> DataFrame:
    """Gaps look back within runs of 65536 ids; a run's first event looks at the last one of the runs before."""
    rows = t.events.select("event_type", "value", "event_id", F.ceil(F.col("event_id") / 1000).alias("bucket"), R.by_value("event_id").alias("run"))
    last = rows.groupBy("event_type", "run").agg(F.max("event_id").alias("last"))
    earlier = F.max("last").over(Window.partitionBy("event_type").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(F.col("event_type").alias("of"), F.col("run").alias("of_run"), earlier.alias("earlier"))
    rows = rows.withColumn("before", F.lag("event_id").over(Window.partitionBy("event_type", "run").orderBy("event_id")))
    rows = rows.join(last, F.col("event_type").eqNullSafe(F.col("of")) & F.col("run").eqNullSafe(F.col("of_run")))
    e = rows.select("event_type", "value", "bucket", (F.col("event_id") - F.coalesce("before", "earlier")).alias("gap"))
    return e.groupBy("event_type", "bucket").agg(
        F.count("*").alias("n"), F.max("gap").alias("max_gap"), F.round(F.median("gap"), 3).alias("median_gap"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("""
SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS before_n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS after_n,
  round(quantile_cont(value, 0.95) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 6) AS after_p95 FROM events GROUP BY 1
""")
def event_phase_rates(t: Tables) -> DataFrame:
    after = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    return t.events.groupBy("event_type").agg(F.count_if(~after).alias("before_n"), F.count_if(after).alias("after_n"), F.round(F.percentile(F.when(after, F.col("value")), 0.95), 6).alias("after_p95"))


@query("""
WITH f AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
SELECT user_id, island::BIGINT AS island, max(event_id) AS last_id, count(*) AS n FROM i GROUP BY 1, 2
""")
def gap_islands(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.withColumn("down", F.col("value") < F.lag("value").over(w))
    return R.islands(e, ["user_id"], ["event_id"], F.coalesce("down", F.lit(False))).groupBy("user_id", "island").agg(F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT source, n, unnest(range(1, least(n, 200) + 1)) AS k FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY k / sqrt(n), source, k) AS rn FROM s)
SELECT source, count(*) AS quota FROM r WHERE rn <= 200 GROUP BY source
""")
def sqrt_quota(t: Tables) -> DataFrame:
    """The greedy rule takes seats in the order of k / sqrt(n); no group can take more than all seats."""
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    seats = c.select("source", "n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(200)).cast("int"))).alias("k"))
    return seats.orderBy(F.col("k") / F.sqrt("n"), "source", "k").limit(200).groupBy("source").agg(F.count("*").alias("quota"))


def balanced(counts: dict[str, int], target: int) -> dict[str, int]:
    """Equal shares capped by the counts, round after round.

    A round's remainder goes one each to the first names that are not
    full, also where the cap then takes it back.
    """
    quota = dict.fromkeys(sorted(counts), 0)
    while (left := min(target, sum(counts.values())) - sum(quota.values())) > 0:
        unfilled = [k for k in quota if quota[k] < counts[k]]
        each, spare = divmod(left, len(unfilled))
        for place, k in enumerate(unfilled):
            quota[k] = min(counts[k], quota[k] + each + (place < spare))
    return quota


#: The rule over the counts, round after round, in SQL: what is left is dealt evenly to sources that are not full.
BALANCED = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), goal AS (SELECT least(333, sum(n))::BIGINT AS goal FROM c),
q AS (SELECT source, n, 0::BIGINT AS quota, 0::BIGINT AS round, (SELECT goal FROM goal) AS remaining FROM c
  UNION ALL
  SELECT source, n, quota, round, ((SELECT goal FROM goal) - sum(quota) OVER ())::BIGINT FROM (
    SELECT source, n, round + 1 AS round,
      least(n, quota + CASE WHEN quota < n THEN remaining // open + (place < remaining % open)::INT ELSE 0 END)::BIGINT AS quota
    FROM (SELECT *, sum((quota < n)::INT) OVER () AS open, sum((quota < n)::INT) OVER (ORDER BY source) - 1 AS place FROM q WHERE remaining > 0)))
SELECT d.source, d.doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d
JOIN (SELECT source, max(quota) AS quota FROM q GROUP BY source) f ON d.source = f.source WHERE rn <= quota
"""


@query(BALANCED)
def balanced_quota(t: Tables) -> DataFrame:
    """Quotas from the small table of counts, then the documents of each source up to its quota."""
    target = 333
    counts = {r["source"]: r["count"] for r in t.documents.where("source is not null").groupBy("source").count().collect()}  # a row for each source
    quota = t.spark.createDataFrame(sorted(balanced(counts, target).items()), "source string, quota int")
    ranked = R.bottom_k(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], target)
    return ranked.join(F.broadcast(quota), "source").where("rank <= quota").select("source", "doc_id")


@query("""
WITH c AS (SELECT source, sum(n_chars)::DOUBLE AS capacity FROM documents GROUP BY source),
s AS (SELECT *, coalesce(sum(capacity) OVER w, 0) AS full_below, sum(sqrt(capacity)) OVER () - coalesce(sum(sqrt(capacity)) OVER w, 0) AS roots, 0.5 * sum(capacity) OVER () AS target
  FROM c WINDOW w AS (ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (target - full_below) / roots AS f FROM s WHERE roots > 0 AND (target - full_below) / roots <= sqrt(capacity) ORDER BY capacity, source LIMIT 1)
SELECT source, capacity, round(least(capacity, f * sqrt(capacity)), 4) AS allocated FROM c CROSS JOIN f
""")
def sqrt_waterfill(t: Tables) -> DataFrame:
    """min(cap, f * sqrt(cap)) with the factor f found by bisection over the small table of capacities."""
    caps = {r["source"]: float(r["s"]) for r in t.documents.groupBy("source").agg(F.sum("n_chars").alias("s")).collect()}  # a row for each source
    given = allocated(caps, 0.5 * sum(caps.values()))
    return t.spark.createDataFrame([(k, c, round(given[k], 4)) for k, c in caps.items()], "source string, capacity double, allocated double")


def allocated(caps: dict[str, float], target: float, factors: dict[str, float] | None = None) -> dict[str, float]:
    """Shares by the root of the capacity times a factor (1 unless named), cut at the capacity, that sum to the target."""
    weight = {k: (factors or {}).get(k, 1.0) * c**0.5 for k, c in caps.items()}
    lo, hi = 0.0, max((c / weight[k] for k, c in caps.items() if weight[k]), default=1.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * weight[k]) for k, c in caps.items()) < target else (lo, mid)
    return {k: min(c, hi * weight[k]) for k, c in caps.items()}


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('half|' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE rn <= ceil(n / 2.0)
""")
def half_per_stratum(t: Tables) -> DataFrame:
    """The lower half of each stratum's hashes."""
    d = t.documents.select("doc_id", "lang", T.digest(F.lit("half"), "doc_id").alias("h"))
    r = R.prefix(d, ["lang"], ["h"], R.by_digits("h"), F.lit(1), "before", "n")
    return r.where(F.col("before") < F.ceil(F.col("n") / 2)).select("doc_id", "lang")


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY rn, lang) AS seq FROM r WHERE rn <= 100)
SELECT seq, doc_id, lang FROM o WHERE seq <= 100
""")
def round_robin(t: Tables) -> DataFrame:
    top = R.bottom_k(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"], 100).orderBy("rank", "lang").limit(100)
    return top.select(F.row_number().over(Window.orderBy("rank", "lang")).alias("seq"), "doc_id", "lang")  # 100 rows


@query("SELECT lang, doc_id, rn AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed|' || lang || '|' || doc_id)) AS rn FROM documents) WHERE rn <= 20")
def bottom_k_hash(t: Tables) -> DataFrame:
    return R.bottom_k(t.documents.select("lang", "doc_id", T.digest(F.lit("seed"), "lang", "doc_id").alias("h")), ["lang"], ["h"], 20).select("lang", "doc_id", "rank")


@query("""
WITH q AS (SELECT source, (count(*) + 9) // 10 AS quota FROM documents GROUP BY source), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('strata|' || doc_id)) AS rn FROM documents)
SELECT source, doc_id FROM r JOIN q USING (source) WHERE rn <= quota
""")
def stratified_hash_sample(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", T.digest(F.lit("strata"), "doc_id").alias("h"))
    r = R.prefix(d, ["source"], ["h"], R.by_digits("h"), F.lit(1), "before", "n")
    return r.where(F.col("before") < F.floor((F.col("n") + 9) / 10)).select("source", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE {UNIT.format(chr(39) + 'sample|' + chr(39) + ' || doc_id')} < 0.1")
def hash_threshold_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").where(T.hash60(T.digest(F.lit("sample"), "doc_id")) / float(1 << 60) < 0.1)


@query("SELECT doc_id, ('0x' || substr(sha256('p|' || doc_id), 1, 15))::BIGINT % 16 AS part, ('0x' || substr(sha256('q|' || doc_id), 1, 15))::BIGINT % 4 AS sub FROM documents")
def hash_partition(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (T.hash60(T.digest(F.lit("p"), "doc_id")) % 16).alias("part"), (T.hash60(T.digest(F.lit("q"), "doc_id")) % 4).alias("sub"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('reservoir|' || doc_id)) AS rn FROM documents) WHERE rn <= 5")
def reservoir_sample(t: Tables) -> DataFrame:
    """Fixed-size samples by hash order, which does not depend on the order of rows."""
    return R.bottom_k(t.documents.select("source", "doc_id", T.digest(F.lit("reservoir"), "doc_id").alias("h")), ["source"], ["h"], 5).select("source", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('global|' || doc_id) LIMIT 50")
def global_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(T.digest(F.lit("global"), "doc_id")).limit(50)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), s AS (SELECT unnest(range(0, 25)) AS i)
SELECT i, doc_id FROM s JOIN r ON k = round_even(i * (n - 1) / 24.0, 0)::BIGINT
""")
def even_sample(t: Tables) -> DataFrame:
    """Ranks from counts of equal lengths: only the groups that hold a wanted rank are opened."""
    n = t.documents.count()
    sizes = t.documents.groupBy("n_chars").agg(F.count("*").alias("c"))
    wide = sizes.withColumn("bucket", F.floor(F.col("n_chars") / 256))
    sums = wide.groupBy("bucket").agg(F.sum("c").alias("s"))
    base = sums.select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = wide.withColumn("inside", inside).join(base, "bucket").select("n_chars", (F.col("base") + F.col("inside")).alias("lo"), "c")
    wanted = t.spark.range(25).select(F.col("id").alias("i"), F.bround(F.col("id") * F.lit(n - 1) / 24, 0).cast("long").alias("k"))
    hit = F.broadcast(wanted).join(starts, (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("lo") + F.col("c")))
    rows = t.documents.select("n_chars", "doc_id").join(hit.select("n_chars").distinct(), "n_chars", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")) - 1)
    return hit.join(rows, "n_chars").where(F.col("r") == F.col("k") - F.col("lo")).select("i", "doc_id")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def top_n(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "p_retailprice")


@query(r"""
WITH f AS (SELECT DISTINCT source FROM documents), s AS (SELECT source, row_number() OVER (ORDER BY sha256('split|' || source)) AS rn, count(*) OVER () AS n FROM f),
x AS (SELECT source, CASE WHEN rn <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS part FROM s)
SELECT part, count(*) AS n, count(DISTINCT source) AS families FROM documents JOIN x USING (source) GROUP BY part
""")
def group_split(t: Tables) -> DataFrame:
    """Whole families go to one side; the families are few against the rows."""
    f = t.documents.select("source").distinct()
    rn, n = F.row_number().over(Window.orderBy(T.digest(F.lit("split"), "source"))), F.count("*").over(Window.partitionBy())
    x = f.withColumn("rn", rn).withColumn("n", n).select("source", F.when(F.col("rn") <= F.ceil(F.col("n") * 0.2), "validation").otherwise("train").alias("part"))
    return t.documents.select("source").join(x, "source").groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("source").alias("families"))


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def union_distinct(t: Tables) -> DataFrame:
    ids = [t.labels.where("quality = 1"), t.labels.where("toxic = 1"), t.documents.where("doc_id % 9 = 0")]
    return ids[0].select("doc_id").union(ids[1].select("doc_id")).union(ids[2].select("doc_id")).distinct()


@query("""
WITH s AS (SELECT doc_id % 4 AS shard, doc_id, n_chars FROM documents)
SELECT shard, doc_id, (sum(n_chars) OVER (ORDER BY shard, doc_id) - n_chars)::BIGINT AS start FROM s
""")
def union_all(t: Tables) -> DataFrame:
    """Shards one after another; pointers move by the shards before, and inside a shard by runs of ids."""
    shards = [t.documents.where(F.col("doc_id") % 4 == k).select(F.lit(k).cast("long").alias("shard"), "doc_id", "n_chars") for k in range(4)]
    s = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    totals = s.groupBy("shard").agg(F.sum("n_chars").alias("total"))
    base = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    s = R.prefix(s, ["shard"], ["doc_id"], R.by_value("doc_id"), F.col("n_chars"), "inside")
    return s.join(F.broadcast(base), "shard").select("shard", "doc_id", (F.col("base") + F.col("inside")).alias("start"))  # 4 shards


@query("""
WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right
""")
def intersect_except(t: Tables) -> DataFrame:
    g = t.documents.groupBy(F.sha2("text", 256)).agg(F.bool_or(F.col("doc_id") % 2 == 0).alias("a"), F.bool_or(F.col("doc_id") % 2 == 1).alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_left"), F.count_if(~F.col("a") & F.col("b")).alias("only_right"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum((part IS NULL)::INT)::BIGINT AS uncovered, sum((part = 0)::INT)::BIGINT AS first_part FROM (SELECT doc_id, doc_id % 3 AS part FROM documents)")
def partition_cover(t: Tables) -> DataFrame:
    p = t.documents.select("doc_id", (F.col("doc_id") % 3).alias("part"))
    return p.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("part").isNull()).alias("uncovered"), F.count_if(F.col("part") == 0).alias("first_part"))


@query(r"""
WITH k AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS part, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents)
SELECT h FROM k WHERE part = 'test' INTERSECT SELECT h FROM k WHERE part = 'train'
""")
def split_leakage(t: Tables) -> DataFrame:
    k = t.documents.select(T.fingerprint("text").alias("h"), (F.col("doc_id") % 10 == 0).alias("test"))
    return k.where("test").select("h").intersect(k.where("not test").select("h"))
