"""Graphs and recursion, state and streaming (survey 2.N and 2.O)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators.graph import closure, layers
from siltstone.registry import Tables, query
from siltstone.streaming.events import counted_by_window, drained

#: Part keys stand for nodes; each node hangs on the node at a third of its key.
EDGES = "(SELECT p_partkey // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0 AND p_partkey // 3 <> p_partkey)"


def _edges(t: Tables) -> DataFrame:
    parent = F.floor(F.col("p_partkey") / 3)
    return t.part.where("p_partkey > 0").select(parent.alias("parent"), F.col("p_partkey").alias("child")).where("parent <> child")


@query(f"""
WITH RECURSIVE c AS (SELECT parent AS ancestor, child AS node FROM {EDGES} UNION SELECT c.ancestor, e.child FROM c JOIN {EDGES} e ON c.node = e.parent)
SELECT ancestor, count(*) AS descendants FROM c GROUP BY ancestor
""")
def dag_closure(t: Tables) -> DataFrame:
    return closure(_edges(t)).groupBy("ancestor").agg(F.count("*").alias("descendants"))


@query(f"""
WITH RECURSIVE c AS (SELECT parent AS ancestor, child AS node FROM {EDGES} UNION SELECT c.ancestor, e.child FROM c JOIN {EDGES} e ON c.node = e.parent),
n AS (SELECT parent AS node FROM {EDGES} UNION SELECT child FROM {EDGES})
SELECT n.node, CASE WHEN n.node % 97 = 5 THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM c WHERE c.ancestor = n.node AND c.node % 97 = 5) THEN 'partial' ELSE 'resolved' END AS status FROM n
""")
def dag_status(t: Tables) -> DataFrame:
    """Ancestors of an unresolved node are partial."""
    e = _edges(t)
    nodes = e.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    partial = closure(e).where("node % 97 = 5").select(F.col("ancestor").alias("node")).distinct().withColumn("partial", F.lit(True))
    status = T.first_rule([(F.col("node") % 97 == 5, "unresolved"), (F.col("partial"), "partial")], "resolved")
    return nodes.join(partial, "node", "left").select("node", status.alias("status"))


@query(f"""
WITH RECURSIVE c AS (SELECT parent AS ancestor, child AS node FROM {EDGES} UNION SELECT c.ancestor, e.child FROM c JOIN {EDGES} e ON c.node = e.parent),
u AS (SELECT ancestor, node, count(*) OVER (PARTITION BY ancestor) AS n FROM c WHERE node % 97 = 5)
SELECT node AS leaf, count(*) AS unlocked FROM u WHERE n = 1 GROUP BY node
""")
def dag_leverage(t: Tables) -> DataFrame:
    """Ancestors that a single unresolved node keeps from being resolved."""
    u = closure(_edges(t)).where("node % 97 = 5").withColumn("n", F.count("*").over(Window.partitionBy("ancestor")))
    return u.where("n = 1").groupBy(F.col("node").alias("leaf")).agg(F.count("*").alias("unlocked"))


@query("""
WITH d AS (SELECT o_orderkey AS job, o_orderkey // 2 AS needs FROM orders WHERE o_orderkey > 1), s AS (SELECT o_orderkey AS job, o_orderstatus AS status FROM orders)
SELECT s.job FROM s LEFT JOIN d USING (job) LEFT JOIN s p ON p.job = d.needs WHERE s.status = 'O' AND (p.job IS NULL OR p.status = 'F') ORDER BY s.job LIMIT 100
""")
def ready_jobs(t: Tables) -> DataFrame:
    s = t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"))
    waiting = s.where("status = 'O'").select("job", F.when(F.col("job") > 1, F.floor(F.col("job") / 2)).alias("needs"))
    unfinished = s.where("status <> 'F'").select(F.col("job").alias("needs"))
    return waiting.join(unfinished, "needs", "left_anti").orderBy("job").limit(100).select("job")


@query(f"""
WITH RECURSIVE n AS (SELECT parent AS node FROM {EDGES} UNION SELECT child FROM {EDGES}),
l AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT child FROM {EDGES}) UNION ALL SELECT e.child, l.layer + 1 FROM l JOIN {EDGES} e ON e.parent = l.node)
SELECT node, max(layer)::INTEGER AS layer FROM l GROUP BY node
""")
def dag_validate(t: Tables) -> DataFrame:
    """The layer of each node once all it hangs on is placed; nodes of a cycle never are."""
    return layers(_edges(t))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) AND d.doc_id % 2 = 0")
def journal_resume(t: Tables) -> DataFrame:
    """Pending is the input minus the journal."""
    return t.documents.where("doc_id % 2 = 0").select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_available_now(t: Tables) -> DataFrame:
    """The events as a stream with a watermark, drained: daily windows."""
    return drained(counted_by_window(t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder), "1 day"))


@query("SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS window_start FROM events) GROUP BY 1, 2")
def sliding_windows(t: Tables) -> DataFrame:
    """An extension: windows of twelve hours every six."""
    return t.events.groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS s, event_id FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, session
""")
def session_windows(t: Tables) -> DataFrame:
    """An extension: sessions that end after eight hours of silence."""
    return t.events.groupBy("user_id", F.session_window("ts", "8 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, event_type FROM events)
SELECT user_id, event_id, attempt, CASE WHEN event_type = 'purchase' THEN 'done' WHEN attempt > 4 THEN 'failed' WHEN next_ts IS NULL OR next_ts - ts > INTERVAL 15 MINUTE THEN 'expired' ELSE 'leased' END AS state FROM r
""")
def lease_state(t: Tables) -> DataFrame:
    """A user's events stand for claims of one job: leases of 15 minutes, four attempts, a purchase finishes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = t.events.select("user_id", "event_id", "event_type", F.row_number().over(w).alias("attempt"), (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap"))
    state = T.first_rule([(F.col("event_type") == "purchase", "done"), (F.col("attempt") > 4, "failed"), (F.col("gap").isNull() | (F.col("gap") > 900_000_000), "expired")], "leased")
    return r.select("user_id", "event_id", "attempt", state.alias("state"))


@query("SELECT source, count(*) AS n, max(rn) = count(*) AS contiguous, min(doc_id) AS first, max(doc_id) AS cursor FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY source")
def contiguous_cursor(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), (F.countDistinct("doc_id") == F.count("*")).alias("contiguous"), F.min("doc_id").alias("first"), F.max("doc_id").alias("cursor"))


@query("""
WITH c AS (SELECT user_id, max(event_id) AS token FROM events WHERE event_type <> 'purchase' GROUP BY 1)
SELECT e.user_id, e.event_id, coalesce(e.event_id > c.token, true) AS accepted FROM events e LEFT JOIN c USING (user_id) WHERE event_type = 'purchase'
""")
def fenced_claim(t: Tables) -> DataFrame:
    """A purchase finishes a user's last claim; one before a later claim is stale."""
    token = F.max(F.when(F.col("event_type") != "purchase", F.col("event_id"))).over(Window.partitionBy("user_id"))
    e = t.events.select("user_id", "event_id", "event_type", token.alias("token")).where("event_type = 'purchase'")
    return e.select("user_id", "event_id", F.coalesce(F.col("event_id") > F.col("token"), F.lit(True)).alias("accepted"))


@query("""
WITH n AS (SELECT doc_id, quality + 10 AS quality FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, 5 FROM labels WHERE doc_id % 50 = 0)
SELECT coalesce(n.doc_id, l.doc_id) AS doc_id, coalesce(n.quality, l.quality) AS quality FROM labels l FULL JOIN n ON n.doc_id = l.doc_id
""")
def upsert_merge(t: Tables) -> DataFrame:
    """The later version of each key wins."""
    old = t.labels.select("doc_id", "quality", F.lit(0).alias("v"))
    new = t.labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality") + 10, F.lit(1)).union(t.labels.where("doc_id % 50 = 0").select(F.col("doc_id") + 1000000, F.lit(5), F.lit(1)))
    return old.union(new).groupBy("doc_id").agg(F.max_by("quality", "v").alias("quality"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS global_row FROM documents WHERE doc_id >= 500")
def resume_cursor(t: Tables) -> DataFrame:
    """Rows from a cursor on, numbered: runs of 65536 ids are counted first."""
    d = t.documents.where("doc_id >= 500").select("doc_id", F.floor(F.col("doc_id") / 65536).alias("run"))
    counts = d.groupBy("run").count()
    base = counts.select("run", F.coalesce(F.sum("count").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("run").orderBy("doc_id")) - 1
    return d.withColumn("n", n).join(base, "run").select("doc_id", (F.col("base") + F.col("n")).alias("global_row"))
