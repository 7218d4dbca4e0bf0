"""Joins, aggregations and reporting (survey 2.D and 2.E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators import relational as R
from siltstone.registry import Tables, query


@query("""
WITH b AS (SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2)
SELECT s_suppkey, c_mktsegment, c_custkey FROM supplier JOIN b ON s_nationkey = c_nationkey
""")
def hash_join(t: Tables) -> DataFrame:
    """The last row of each key builds; the other side probes."""
    b = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_custkey").alias("c_custkey"))
    return t.supplier.join(b, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_mktsegment", "c_custkey")


@query("""
WITH u AS (SELECT lang, n_chars % 997 AS pivot, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.lang AS left_lang, b.lang AS right_lang FROM u a JOIN u b ON a.pivot = b.pivot AND a.lang < b.lang
""")
def pivot_self_join(t: Tables) -> DataFrame:
    """Rows unique for (language, pivot) meet across languages on the pivot."""
    u = t.documents.groupBy("lang", (F.col("n_chars") % 997).alias("pivot")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
    a, b = (u.select("pivot", F.col("doc_id").alias(f"{x}_id"), F.col("lang").alias(f"{x}_lang")) for x in ("left", "right"))
    return a.join(b, "pivot").where("left_lang < right_lang").drop("pivot")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def left_semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT lang, count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def left_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("orphans"))


@query("""
WITH o AS (SELECT doc_id, text, source FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN 'moved' ELSE source END AS source FROM documents)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (doc_id) WHERE o.doc_id IS NULL OR n.text IS DISTINCT FROM o.text OR n.source IS DISTINCT FROM o.source
""")
def table_diff(t: Tables) -> DataFrame:
    new = t.documents.withColumn("source", F.when(F.col("doc_id") % 13 == 0, "moved").otherwise(F.col("source")))
    return R.differences(t.documents.where("doc_id % 11 <> 0"), new, "doc_id", ["text", "source"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'")
def latest_attempt(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type").where("event_type <> 'purchase'")


@query("""
WITH i AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS lo, sum(p_size) OVER (ORDER BY p_partkey) AS hi FROM part),
o AS (SELECT o_orderkey, o_orderkey % (SELECT sum(p_size) FROM part) AS pos FROM orders)
SELECT p_partkey, count(*) AS n FROM o JOIN i ON pos >= lo AND pos < hi GROUP BY 1
""")
def range_join(t: Tables) -> DataFrame:
    """Offsets fall into intervals of running sums; part keys are dense, so runs of 4096 of them are summed first."""
    p = t.part.select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 4096).alias("run"))
    runs = p.groupBy("run").agg(F.sum("p_size").alias("s"))
    base = runs.select("run", F.coalesce(F.sum("s").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    hi = F.sum("p_size").over(Window.partitionBy("run").orderBy("p_partkey"))
    i = p.withColumn("hi", hi).join(base, "run").select("p_partkey", (F.col("base") + F.col("hi") - F.col("p_size")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    total = t.part.agg(F.sum("p_size").alias("total"))  # one row
    o = t.orders.crossJoin(F.broadcast(total)).select((F.col("o_orderkey") % F.col("total")).alias("pos"))
    return R.range_join(o, i, "pos", "lo", "hi", 64).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'unknown' END AS kind FROM part WHERE p_size <= 2 GROUP BY p_brand)
SELECT p.p_brand, coalesce(kind, 'missing') AS kind, count(*) AS n FROM part p LEFT JOIN l USING (p_brand) GROUP BY 1, 2
""")
def lookup_conflict_join(t: Tables) -> DataFrame:
    lookup = R.unique_lookup(t.part.where("p_size <= 2"), ["p_brand"], "p_type").withColumnRenamed("p_type", "kind")
    return t.part.select("p_brand").join(lookup, "p_brand", "left").groupBy("p_brand", F.coalesce("kind", F.lit("missing")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 10 < 10 GROUP BY 1")
def explode_join(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    rows = t.orders.select("o_orderkey").join(ids, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("parts").alias("p_partkey"))
    found = rows.join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return found.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_skyline(t: Tables) -> DataFrame:
    """Best price of each size, then a running maximum over the sizes: no pairs are compared."""
    best = t.part.groupBy("p_size").agg(F.max("p_retailprice").alias("top"))
    w = Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size
    front = best.withColumn("before", F.max("top").over(w)).where("before is null or top > before").select("p_size", "top")
    return t.part.join(front, "p_size").where("p_retailprice = top").select("p_partkey")


@query("""
WITH a AS (SELECT n_nationkey, regexp_replace(lower(CASE WHEN n_nationkey % 2 = 0 THEN '  ' || upper(n_name) || '!' ELSE n_name || 'x' END), '[^a-z0-9]', '', 'g') AS k FROM nation),
r AS (SELECT n_regionkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k FROM nation)
SELECT n_nationkey, coalesce(n_regionkey::VARCHAR, 'unmapped') AS region FROM a LEFT JOIN r USING (k)
""")
def normalized_name_join(t: Tables) -> DataFrame:
    """Names spelt otherwise, and names that are none, looked up by their letters and digits in lower case."""
    name = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "").alias("k")
    spelt = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), F.upper("n_name"), F.lit("!"))).otherwise(F.concat("n_name", F.lit("x")))
    a, r = t.nation.select("n_nationkey", name(spelt)), t.nation.select("n_regionkey", name("n_name"))
    return a.join(r, "k", "left").select("n_nationkey", F.coalesce(F.col("n_regionkey").cast("string"), F.lit("unmapped")).alias("region"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(n_chars) AS least, max(n_chars) AS most, sum((text IS NULL)::INT)::BIGINT AS missing FROM documents GROUP BY 1, 2")
def group_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("text").isNull()).alias("missing")
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def status_breakdown(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""
SELECT lang, quality, count(*) AS n, round(avg(toxic), 6) AS toxic, grouping(lang, quality)::BIGINT AS cut
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (lang, quality)) HAVING count(*) >= 5
""")
def grouping_sets(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    cut = d.groupingSets([[], ["lang"], ["lang", "quality"]], "lang", "quality")
    return cut.agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic"), F.grouping_id("lang", "quality").alias("cut")).where("n >= 5")


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, sum((value >= 50)::INT)::BIGINT AS over_50 FROM events GROUP BY 1
""")
def metric_percentiles(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("value").alias("most"), F.count_if(F.col("value") >= 50).alias("over_50")
    )


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN k = round_even((n - 1) * 0.95, 0)::BIGINT THEN value END) AS half_even, max(CASE WHEN k = ((n - 1) * 95) // 100 THEN value END) AS floored FROM r GROUP BY 1
""")
def percentile_nearest(t: Tables) -> DataFrame:
    """Exact ranks from counts of distinct values, so that no group is sorted as a whole."""
    c = t.events.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("value")
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
    return c.groupBy("event_type").agg(at(F.bround((F.col("n") - 1) * 0.95, 0).cast("long")).alias("half_even"), at(F.floor((F.col("n") - 1) * 95 / 100)).alias("floored"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def numeric_profile(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.median("c_acctbal"), 4).alias("median"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query("SELECT lang, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY lang")
def share_of_total(t: Tables) -> DataFrame:
    g = t.documents.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    return g.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 6))


@query("""
WITH s AS (SELECT doc_id % 4 AS shard, lang, count(*) AS n, avg(n_chars) AS v FROM documents GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS n, round(sum(v * n) / sum(n), 6) AS v FROM s GROUP BY lang
""")
def weighted_merge(t: Tables) -> DataFrame:
    s = t.documents.groupBy((F.col("doc_id") % 4).alias("shard"), "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("v"))
    return s.groupBy("lang").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("v"))


@query("""
WITH s AS (SELECT source, lang, avg(quality) AS v, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT lang, round(sum(v * n) / sum(n), 6) AS micro, round(avg(v), 6) AS macro FROM s GROUP BY lang
""")
def macro_average(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("v"), F.count("*").alias("n"))
    return s.groupBy("lang").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("micro"), F.round(F.avg("v"), 6).alias("macro"))


@query("""
WITH m AS (SELECT event_type, avg(value) AS v, max(value) AS top FROM events GROUP BY 1), n AS (SELECT event_type, CASE WHEN top > 1 THEN v / 100 ELSE v END AS v, CASE WHEN event_type < 'm' THEN 'early' ELSE 'late' END AS section FROM m),
s AS (SELECT section, avg(v) AS v FROM n GROUP BY section)
SELECT section, round(v, 6) AS section_mean, round(avg(v) OVER (), 6) AS suite_mean FROM s
""")
def section_average(t: Tables) -> DataFrame:
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("v"), F.max("value").alias("top"))
    n = m.select(F.when(F.col("top") > 1, F.col("v") / 100).otherwise(F.col("v")).alias("v"), F.when(F.col("event_type") < "m", "early").otherwise("late").alias("section"))
    s = n.groupBy("section").agg(F.avg("v").alias("v"))
    return s.select("section", F.round("v", 6).alias("section_mean"), F.round(F.avg("v").over(Window.partitionBy()), 6).alias("suite_mean"))


@query("""
WITH e AS (SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s),
a AS (SELECT lang, source, avg(quality) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT e.lang, count(v) AS present, count(*) AS expected, count(v) = count(*) AS complete, round(avg(v), 6) AS available_mean FROM e LEFT JOIN a ON e.lang = a.lang AND e.source = a.source GROUP BY e.lang
""")
def coverage_average(t: Tables) -> DataFrame:
    """Every language is expected in every source; the number of sources is enough to know what is missing."""
    sources = t.documents.agg(F.countDistinct("source").alias("expected"))  # one row
    a = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").groupBy("lang", "source").agg(F.avg("quality").alias("v"))
    langs = t.documents.select("lang").distinct()
    g = langs.join(a.groupBy("lang").agg(F.count("v").alias("present"), F.avg("v").alias("m")), "lang", "left").crossJoin(F.broadcast(sources))
    present = F.coalesce("present", F.lit(0))
    return g.select("lang", present.alias("present"), "expected", (present == F.col("expected")).alias("complete"), F.round("m", 6).alias("available_mean"))


@query("SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def stratum_counts(t: Tables) -> DataFrame:
    b = T.first_rule([(F.col("n_chars") < 1000, "short"), (F.col("n_chars") < 4000, "medium")], "long")
    return t.documents.groupBy("lang", b.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT least(l_linenumber, 4) AS bin, round(sum(l_quantity), 2) AS weight, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def weighted_histogram(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.least("l_linenumber", F.lit(4)).alias("bin")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"), F.countDistinct("l_partkey").alias("parts"))


@query("""
WITH a AS (SELECT DISTINCT sha256(text) AS h, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha256(text) AS h, lang FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(a.lang, b.lang) AS lang, count(a.h) AS left_n, count(b.h) AS right_n, sum((a.h IS NOT NULL AND b.h IS NOT NULL)::INT)::BIGINT AS shared FROM a FULL JOIN b ON a.h = b.h AND a.lang = b.lang GROUP BY 1
""")
def table_overlap_report(t: Tables) -> DataFrame:
    """Even and odd ids stand for two tables; one aggregate of both replaces the full join."""
    d = t.documents.groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.max((F.col("doc_id") % 2 == 0).cast("int")).alias("a"), F.max((F.col("doc_id") % 2 == 1).cast("int")).alias("b"))
    return d.groupBy("lang").agg(F.sum("a").alias("left_n"), F.sum("b").alias("right_n"), F.sum(F.col("a") * F.col("b")).alias("shared"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs FROM documents GROUP BY source")
def source_exposure(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))


@query("""
WITH w AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n, count(*) AS b FROM events GROUP BY 1)
SELECT event_type, n, round((n / sum(n) OVER ()) / (b / sum(b) OVER ()), 6) AS ratio FROM w WHERE n >= 20
""")
def share_vs_baseline(t: Tables) -> DataFrame:
    w = t.events.groupBy("event_type").agg(F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("n"), F.count("*").alias("b")).where("n >= 20")
    all_ = Window.partitionBy()
    return w.select("event_type", "n", F.round((F.col("n") / F.sum("n").over(all_)) / (F.col("b") / F.sum("b").over(all_)), 6).alias("ratio"))


@query(r"""
SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h, count(*) AS n, sum((n_chars > 2000)::INT)::BIGINT AS n_long, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs FROM documents GROUP BY 1
""")
def doc_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy(T.fingerprint("text").alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))


@query("""
WITH a AS (SELECT source, sum(quality)::BIGINT AS accepted, count(*) AS n, avg(n_chars) AS len FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, accepted, round(1 - accepted / n, 6) AS reject_rate, accepted * len >= 20000 AS reached FROM a
""")
def target_status(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").groupBy("source").agg(F.sum("quality").alias("accepted"), F.count("*").alias("n"), F.avg("n_chars").alias("len"))
    return a.select("source", "accepted", F.round(1 - F.col("accepted") / F.col("n"), 6).alias("reject_rate"), (F.col("accepted") * F.col("len") >= 20000).alias("reached"))


@query("""
WITH s AS (SELECT event_type, median(value) AS m, max(value) AS top, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, array_to_string(list_filter([CASE WHEN m > 20 THEN 'median_high' END, CASE WHEN top > 100 THEN 'max_high' END, CASE WHEN n > 2000 THEN 'busy' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s
""")
def threshold_alerts(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type").agg(F.median("value").alias("m"), F.max("value").alias("top"), F.count("*").alias("n"))
    found = F.array_compact(F.array(F.when(F.col("m") > 20, F.lit("median_high")), F.when(F.col("top") > 100, F.lit("max_high")), F.when(F.col("n") > 2000, F.lit("busy"))))
    return s.select("event_type", F.array_join(found, ",").alias("warnings"))
