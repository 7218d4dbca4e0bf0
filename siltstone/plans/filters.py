"""Filters and predicates, and scalar functions (survey 2.C and 2.J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.registry import Tables, query

COLLAPSE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def count(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


@query(r"""
SELECT doc_id, length(text) >= 400 AND len(regexp_extract_all(text, '[\p{L}]')) >= 0.55 * length(text) AND NOT contains(text, chr(65533))
  AND len(regexp_extract_all(text, '[^\s]+')) >= 120 AS ok FROM documents
""")
def quality_gate(t: Tables) -> DataFrame:
    x = F.col("text")
    ok = (F.length(x) >= 400) & (F.regexp_count(x, F.lit(r"[\p{L}]")) >= 0.55 * F.length(x)) & ~F.contains(x, F.lit("�")) & (F.regexp_count(x, F.lit(r"[^\s]+")) >= 120)
    return t.documents.select("doc_id", ok.alias("ok"))


@query(r"""
WITH s AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS alnum,
  len(regexp_extract_all(text, '[\p{L}]')) AS letters, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS latin,
  len(regexp_extract_all(text, '\.\.\.')) AS leaders, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT doc_id, CASE WHEN n < 120 THEN 'too_short' WHEN contains(text, chr(65533)) THEN 'control_character'
  WHEN alnum < 0.18 * n THEN 'low_density' WHEN letters - latin > 0.002 * n THEN 'non_latin'
  WHEN len(list_filter(lines, lambda l: length(l) BETWEEN 1 AND 8)) >= 0.25 * len(lines) THEN 'fragments'
  WHEN leaders >= 4 THEN 'dot_leaders' ELSE 'ok' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def ocr_quality_reason(t: Tables) -> DataFrame:
    x, n = F.col("text"), F.length("text")
    c = lambda p: F.regexp_count(x, F.lit(p))
    lines = F.split(x, "\n")
    reason = T.first_rule(
        [
            (n < 120, "too_short"),
            (F.contains(x, F.lit("�")), "control_character"),
            (c(r"[\p{L}\p{N}]") < 0.18 * n, "low_density"),
            (c(r"[\p{L}]") - c("[A-Za-zÀ-ɏ]") > 0.002 * n, "non_latin"),
            (F.size(F.filter(lines, lambda line: F.length(line).between(1, 8))) >= 0.25 * F.size(lines), "fragments"),
            (c(r"\.\.\.") >= 4, "dot_leaders"),
        ],
        "ok",
    )
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(rf"""
SELECT doc_id, length(text) >= 120 AND {count('[^ \n]+')} >= 20 AND regexp_matches(text, '[.!?]$') AND NOT regexp_matches(text, '[<>{{}}|#]')
  AND NOT regexp_matches(text, '^[-*0-9]') AND len(regexp_extract_all(text, '[\p{{L}}]')) > 0.6 * length(text) AS eligible FROM documents
""")
def prose_eligibility(t: Tables) -> DataFrame:
    x = F.col("text")
    ok = (
        (F.length(x) >= 120) & (F.regexp_count(x, F.lit(r"[^ \n]+")) >= 20) & x.rlike(r"[.!?]\z") & ~x.rlike(r"[<>{}|#]") & ~x.rlike("^[-*0-9]")
        & (F.regexp_count(x, F.lit(r"[\p{L}]")) > 0.6 * F.length(x))
    )
    return t.documents.select("doc_id", ok.alias("eligible"))


# Patterns of rights markers, in order of rank.
MARKERS = {
    "public_domain": "public domain|cc0",
    "open_licence": "apache license|mit license|creative commons|cc by|gnu general public",
    "restrictive": "all rights reserved|by-nc|no part of this",
    "government": "government work|crown copyright",
    "copyright": "copyright|©",
}


@query("""
WITH f AS (SELECT doc_id, %s FROM documents)
SELECT CASE WHEN restrictive AND (open_licence OR public_domain) THEN 'mixed' WHEN restrictive THEN 'restrictive' WHEN public_domain THEN 'public_domain'
  WHEN open_licence THEN 'open_licence' WHEN government THEN 'government' WHEN copyright THEN 'copyright' ELSE 'none' END AS stratum, count(*) AS n
FROM f GROUP BY 1
""" % ", ".join(f"regexp_matches(lower(text), '{p}') AS {k}" for k, p in MARKERS.items()))
def license_markers(t: Tables) -> DataFrame:
    f = {k: F.lower("text").rlike(p) for k, p in MARKERS.items()}
    stratum = T.first_rule(
        [
            (f["restrictive"] & (f["open_licence"] | f["public_domain"]), "mixed"),
            *((f[k], k) for k in ("restrictive", "public_domain", "open_licence", "government", "copyright")),
        ],
        "none",
    )
    return t.documents.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))


# Terms of content groups.
GROUPS = {"legal": ["licence", "license", "copyright", "rights"], "technical": ["token", "config", "http", "version"], "contact": ["mail", "example.com", "phone", "@"]}


def _points_sql(terms: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(substr(lower(text), 1, 2000), '{x}') THEN 3 WHEN contains(substr(lower(text), 1, 120000), '{x}') THEN 1 ELSE 0 END" for x in terms)


@query("""
WITH p AS (SELECT doc_id, %s FROM documents)
SELECT doc_id, greatest(legal, technical, contact)::BIGINT AS score,
  CASE WHEN greatest(legal, technical, contact) = 0 THEN 'none' WHEN contact = greatest(legal, technical, contact) THEN 'contact' WHEN legal = greatest(legal, technical, contact) THEN 'legal' ELSE 'technical' END AS kind,
  (legal = greatest(legal, technical, contact))::INT + (technical = greatest(legal, technical, contact))::INT + (contact = greatest(legal, technical, contact))::INT > 1 AS tie
FROM p
""" % ", ".join(f"{_points_sql(x)} AS {k}" for k, x in GROUPS.items()))
def keyword_argmax(t: Tables) -> DataFrame:
    low = F.lower("text")
    head, body = F.substring(low, 1, 2000), F.substring(low, 1, 120000)
    points = {k: sum((F.when(F.contains(head, F.lit(x)), 3).when(F.contains(body, F.lit(x)), 1).otherwise(0) for x in terms), F.lit(0)) for k, terms in GROUPS.items()}
    p = t.documents.select("doc_id", *(v.alias(k) for k, v in points.items()))
    top = F.greatest(*GROUPS)
    kind = T.first_rule([(top == 0, "none"), *((F.col(k) == top, k) for k in sorted(GROUPS))])
    ties = sum(((F.col(k) == top).cast("int") for k in GROUPS), F.lit(0))
    return p.select("doc_id", top.cast("long").alias("score"), kind.alias("kind"), (ties > 1).alias("tie"))


@query(r"""
WITH s AS (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 100000), '[\p{L}]')) AS letters, len(regexp_extract_all(substr(text, 1, 100000), '[一-鿿]')) AS han,
  len(regexp_extract_all(substr(text, 1, 100000), '[Ѐ-ӿ]')) AS cyr, len(regexp_extract_all(substr(text, 1, 100000), '[؀-ۿ]')) AS arab FROM documents)
SELECT CASE WHEN letters = 0 THEN 'latin_or_other' WHEN han >= 0.1 * letters THEN 'han' WHEN cyr >= 0.1 * letters THEN 'cyrillic' WHEN arab >= 0.1 * letters THEN 'arabic' ELSE 'latin_or_other' END AS script, count(*) AS n
FROM s GROUP BY 1
""")
def script_group(t: Tables) -> DataFrame:
    x = F.substring("text", 1, 100000)
    c = lambda p: F.regexp_count(x, F.lit(p))
    n = c(r"[\p{L}]")
    script = T.first_rule([(n == 0, "latin_or_other"), (c("[一-鿿]") >= 0.1 * n, "han"), (c("[Ѐ-ӿ]") >= 0.1 * n, "cyrillic"), (c("[؀-ۿ]") >= 0.1 * n, "arabic")], "latin_or_other")
    return t.documents.groupBy(script.alias("script")).agg(F.count("*").alias("n"))


# Patterns of personal data and secrets, without lookaround so that any engine can run them.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "private_ipv4": r"\b(10\.[0-9]{1,3}|192\.168)\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "api_key": r"(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})",
    "token": r"[Tt][Oo][Kk][Ee][Nn] = .[0-9A-Fa-f]{40}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "password": r"(?i)password\s*[:=]\s*[^\s]{6,}",
    "phone": r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}",
    "long_number": r"\b[0-9]{16}\b",
    "self_identification": r"(?i)my name is [A-Z]",
}


@query("".join(["SELECT * FROM (", " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce(sum(regexp_matches(text, '{p}')::INT), 0)::BIGINT AS n_docs FROM documents" for k, p in PII.items()), ")"]))
def pii_pattern_counts(t: Tables) -> DataFrame:
    sums = t.documents.agg(*(F.coalesce(F.sum(F.col("text").rlike(p).cast("int")), F.lit(0)).alias(k) for k, p in PII.items()))
    return sums.unpivot([], list(PII), "kind", "n_docs")


@query(r"""
WITH h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS hit, substr(text, 1, length(text) // 2) AS candidate FROM documents)
SELECT doc_id, count(*) AS hits, sum(contains(candidate, hit)::INT)::BIGINT AS surviving FROM h GROUP BY doc_id
""")
def pii_survival(t: Tables) -> DataFrame:
    """The first half of a text stands for its rewrite."""
    hits = F.array_distinct(F.regexp_extract_all("text", F.lit(PII["email"]), F.lit(0)))
    half = F.substr(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    d = t.documents.select("doc_id", hits.alias("h"), half.alias("candidate")).where(F.size("h") > 0)
    return d.select("doc_id", F.size("h").cast("long").alias("hits"), F.size(F.filter("h", lambda h: F.contains(F.col("candidate"), h))).cast("long").alias("surviving"))


@query("""
SELECT source, CASE WHEN source IN ('src3', 'src13') THEN 'allowed_by_override' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'denied' WHEN regexp_matches(source, '3$') THEN 'denied' ELSE 'included' END AS state, count(*) AS n
FROM documents GROUP BY 1, 2
""")
def allow_deny(t: Tables) -> DataFrame:
    """Overrides come before denials, denials before the default."""
    s = F.col("source")
    state = T.first_rule([(s.isin("src3", "src13"), "allowed_by_override"), (s.rlike("^src1[0-9]$") | s.rlike("3$"), "denied")], "included")
    return t.documents.groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


# Control marks of chat templates.
CHAT_MARKS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<s>", "</s>", "###", "token ="]


@query("SELECT doc_id, len(list_filter([%s], lambda m: contains(text, m)))::BIGINT AS marks FROM documents WHERE len(list_filter([%s], lambda m: contains(text, m))) > 0" % ((", ".join(f"'{m}'" for m in CHAT_MARKS),) * 2))
def marker_reject(t: Tables) -> DataFrame:
    found = F.filter(F.array(*map(F.lit, CHAT_MARKS)), lambda m: F.contains(F.col("text"), m))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("marks")).where("marks > 0")


@query("SELECT page_id, regexp_matches(lower(html), '<(functions|function_calls|tool_call|script)([ >])') AS quarantined FROM pages")
def tag_quarantine(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.lower("html").rlike("<(functions|function_calls|tool_call|script)([ >])").alias("quarantined"))


@query(f"""
WITH h AS (SELECT doc_id, source, sha256(lower({COLLAPSE})) AS h FROM documents), w AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, min(source) OVER (PARTITION BY h) AS s FROM h)
SELECT doc_id, CASE WHEN n > 2 THEN 'boilerplate' WHEN source <> s THEN 'later_source' ELSE 'kept' END AS state FROM w
""")
def boilerplate_freq(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", "source", T.fingerprint("text").alias("h"))
    g = w.groupBy("h").agg(F.count("*").alias("n"), F.min("source").alias("s"))
    return w.join(g, "h").select("doc_id", T.first_rule([(F.col("n") > 2, "boilerplate"), (F.col("source") != F.col("s"), "later_source")], "kept").alias("state"))


@query(rf"""
WITH t AS (SELECT doc_id, text, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY 1, 2) GROUP BY 1)
SELECT t.doc_id, round(len(regexp_extract_all(text, '\s')) / length(text), 6) AS white, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS distinct_tokens, coalesce(top, 0)::BIGINT AS top_count
FROM t LEFT JOIN c USING (doc_id) WHERE length(text) > 0
""")
def repetition_stats(t: Tables) -> DataFrame:
    d = t.documents.where(F.length("text") > 0).select("doc_id", F.round(T.share("text", r"\s"), 6).alias("white"), T.words("text").alias("w"))
    sizes = d.select("doc_id", "white", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("distinct_tokens"))
    top = d.select("doc_id", F.explode_outer("w").alias("x")).where("x is not null").groupBy("doc_id", "x").count().groupBy("doc_id").agg(F.max("count").alias("top_count"))
    return sizes.join(top, "doc_id", "left").fillna(0, ["top_count"])


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
f AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS s FROM l),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM f), r AS (SELECT doc_id, island, count(*) AS n FROM i GROUP BY 1, 2)
SELECT doc_id, max(n) AS longest, max(n) >= 24 AS looping FROM r GROUP BY doc_id
""")
def loop_guard(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("k")
    lines = t.documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("k", "line"))
    starts = F.when(F.col("line") == F.lag("line").over(w), 0).otherwise(1)
    runs = lines.withColumn("s", starts).withColumn("island", F.sum("s").over(w)).groupBy("doc_id", "island").count()
    return runs.groupBy("doc_id").agg(F.max("count").alias("longest")).withColumn("looping", F.col("longest") >= 24)


@query(r"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, array_to_string(regexp_extract_all(before, '[0-9]+'), ',') = array_to_string(regexp_extract_all(text, '[0-9]+'), ',')
  AND length(text) BETWEEN 0.5 * length(before) AND 2 * length(before) AS preserved FROM p WHERE before IS NOT NULL
""")
def number_preserved(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before is not null")
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    ok = (numbers("before") == numbers("text")) & F.length("text").between(0.5 * F.length("before"), 2 * F.length("before"))
    return p.select("conv_id", "turn", ok.alias("preserved"))


@query(f"""
WITH p AS (SELECT conv_id, turn, {TOKENS} AS w, lag({TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
c AS (SELECT conv_id, turn, list_filter(w, lambda x: length(x) > 2 OR regexp_matches(x, '[0-9]')) AS w, e FROM p WHERE e IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(e, x))) / len(w) ELSE 0 END, 6) AS support FROM c
""")
def support_recall(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select("conv_id", "turn", T.words("text").alias("w"), F.lag("text").over(w).alias("before")).where("before is not null").withColumn("e", T.words("before"))
    content = F.filter("w", lambda x: (F.length(x) > 2) | x.rlike("[0-9]"))
    hit = F.filter(content, lambda x: F.array_contains(F.col("e"), x))
    return p.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(F.size(hit), F.size(content)), F.lit(0.0)), 6).alias("support"))


@query(r"""
SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, 'https?://'))::BIGINT AS urls,
  contains(text, '<GAP>') AS masked, regexp_matches(text, '[#$%&*]{3}') AS artifact FROM documents
""")
def heuristic_audit(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.length(x).cast("long").alias("chars"), F.size(F.split(x, "\n")).cast("long").alias("lines"), F.regexp_count(x, F.lit("https?://")).cast("long").alias("urls"),
        F.contains(x, F.lit("<GAP>")).alias("masked"), x.rlike("[#$%&*]{3}").alias("artifact"),
    )


@query("""
WITH s AS (SELECT source, count(*) AS n, avg(quality) AS usable, 5 - 4 * avg(toxic) AS coherence FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, round(usable, 6) AS usable, CASE WHEN usable < 0.5 OR coherence < 3 THEN 'Repair' WHEN usable < 0.8 OR coherence < 4 THEN 'Filter' ELSE 'Use' END AS disposition FROM s
""")
def quality_disposition(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("usable"), (5 - 4 * F.avg("toxic")).alias("coherence"))
    d = T.first_rule([((F.col("usable") < 0.5) | (F.col("coherence") < 3), "Repair"), ((F.col("usable") < 0.8) | (F.col("coherence") < 4), "Filter")], "Use")
    return s.select("source", "n", F.round("usable", 6).alias("usable"), d.alias("disposition"))


@query("SELECT doc_id, quality IN (0, 1) AND toxic IN (0, 1) AND NOT (quality = 1 AND toxic = 1) AS valid FROM labels")
def verdict_validate(t: Tables) -> DataFrame:
    """A kept row (quality 1) may not be toxic."""
    q, x = F.col("quality"), F.col("toxic")
    return t.labels.select("doc_id", (q.isin(0, 1) & x.isin(0, 1) & ~((q == 1) & (x == 1))).alias("valid"))


@query("""
WITH a AS (SELECT doc_id, quality FROM labels), r AS (SELECT doc_id FROM documents WHERE doc_id % 7 = 0), p AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'unaudited' WHEN quality = 1 AND p.doc_id IS NOT NULL THEN 'published' WHEN quality = 1 THEN 'accepted' WHEN r.doc_id IS NOT NULL THEN 'repaired' ELSE 'rejected' END AS state, count(*) AS n
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY 1
""")
def disposition_states(t: Tables) -> DataFrame:
    """Every seventh document stands for a repaired one, every third for a published one."""
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    state = T.first_rule(
        [(F.col("quality").isNull(), "unaudited"), ((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "published"), (F.col("quality") == 1, "accepted"), (F.col("doc_id") % 7 == 0, "repaired")],
        "rejected",
    )
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, {COLLAPSE} AS clean, CASE WHEN length({COLLAPSE}) > 80 THEN rtrim(substr({COLLAPSE}, 1, 79)) || '…' ELSE {COLLAPSE} END AS clipped FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.collapse("text").alias("clean"), T.clipped("text", 80).alias("clipped"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(173), ''), '-\n', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM documents")
def pdf_clean(t: Tables) -> DataFrame:
    x = F.replace("text", F.lit("­"), F.lit(""))
    return t.documents.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(x, "-\n", ""), r"\n{3,}", "\n\n")).alias("clean"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '_', 'g'), '_') AS slug FROM pages")
def slugify(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.btrim(F.regexp_replace(F.lower("url"), "[^a-z0-9._-]+", "_"), F.lit("_")).alias("slug"))


@query("SELECT doc_id, sha256(source || '|' || doc_id || '|' || lang) AS id FROM documents")
def stable_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.digest("source", "doc_id", "lang").alias("id"))


@query(r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM pages)
SELECT page_id, string_agg(DISTINCT regexp_replace(lower(host), '^www\.', ''), ';' ORDER BY regexp_replace(lower(host), '^www\.', '')) AS domains FROM u GROUP BY page_id
""")
def url_domains(t: Tables) -> DataFrame:
    hosts = F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit("https?://([A-Za-z0-9.-]+)"), F.lit(1))
    clean = F.array_sort(F.array_distinct(F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))))
    return t.pages.select("page_id", F.array_join(clean, ";").alias("domains")).where("domains <> ''")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS day, try_strptime('x' || event_id, '%Y') IS NULL AS bad_is_null FROM events")
def parse_ts(t: Tables) -> DataFrame:
    s = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select("event_id", s.alias("s"), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).alias("day"), F.try_to_timestamp(F.concat(F.lit("x"), "event_id"), F.lit("yyyy")).isNull().alias("bad_is_null"))


@query(r"SELECT doc_id, try_cast(regexp_extract_all(replace(replace(text, ',', ''), '$', ''), '[0-9]+')[-1] AS DOUBLE) AS last_number FROM documents")
def extract_number(t: Tables) -> DataFrame:
    found = F.regexp_extract_all(F.translate("text", ",$", ""), F.lit("[0-9]+"), F.lit(0))
    return t.documents.select("doc_id", F.try_element_at(found, F.lit(-1)).try_cast("double").alias("last_number"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract_all(text, '\(([A-J])\)', 1)[-1], ''), regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([A-J])(?:$|[^\p{L}\p{N}_])', 1)[-1]) AS letter FROM documents")
def extract_letter(t: Tables) -> DataFrame:
    last = lambda p: F.try_element_at(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.lit(-1))
    return t.documents.select("doc_id", F.coalesce(last(r"\(([A-J])\)"), last(r"(?:^|[^\p{L}\p{N}_])([A-J])(?:$|[^\p{L}\p{N}_])")).alias("letter"))


@query("""SELECT event_id, json_extract_string(regexp_extract('```json' || chr(10) || props || chr(10) || '```', '(?s)\\{.*\\}', 0), '$.k') AS k FROM events""".replace("\\\\", "\\"))
def json_from_text(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(fenced, r"(?s)\{.*\}", 0), "$.k").alias("k"))


@query("SELECT event_id, CASE WHEN isfinite(CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE ELSE value END) THEN round(value / 100, 6) END AS scaled FROM events")
def finite_guard(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return t.events.select("event_id", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.round(v / 100, 6)).alias("scaled"))


@query(r"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(?s)\n(Licensed|All rights|Released|This work).*$', ''), chr(10)), lambda x: length(trim(x)) >= 40) AS ps FROM documents)
SELECT doc_id, len(ps)::BIGINT AS paragraphs, array_to_string(ps, chr(10)) AS clean FROM p
""")
def article_clean(t: Tables) -> DataFrame:
    cut = F.regexp_replace("text", r"(?s)\n(Licensed|All rights|Released|This work).*$", "")
    ps = F.filter(F.split(cut, "\n"), lambda x: F.length(F.trim(x)) >= 40)
    return t.documents.select("doc_id", F.size(ps).cast("long").alias("paragraphs"), F.array_join(ps, "\n").alias("clean"))


@query(r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM s
""")
def html_text(t: Tables) -> DataFrame:
    x = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(mark))
    return t.pages.select("page_id", T.collapse(x).alias("text"))
