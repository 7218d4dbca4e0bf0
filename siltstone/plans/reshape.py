"""Projection, reshaping, schema adapters, chunking and text transforms (survey 2.B and 2.K)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.registry import Tables, query

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
MESSAGES = "array<struct<role:string,content:string>>"


@query("SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shape FROM conversations WHERE role <> '' GROUP BY conv_id")
def normalize_messages(t: Tables) -> DataFrame:
    """Message lists as JSON strings, parsed back; entries without a role go."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    raw = t.conversations.groupBy("conv_id").agg(F.to_json(m).alias("raw"))
    ok = F.filter(F.from_json("raw", MESSAGES), lambda x: x["role"].isNotNull() & (x["role"] != ""))
    return raw.select("conv_id", ok.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["content"]).cast("string"))), ",").alias("shape"))


@query(r"""
WITH h AS (SELECT conv_id, turn, role, text, string_agg(role || ': ' || text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS instruction FROM conversations)
SELECT conv_id, turn, instruction, text AS response FROM h WHERE role = 'assistant' AND instruction IS NOT NULL AND trim(text) <> ''
""")
def explode_assistant_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.collect_list(F.concat("role", F.lit(": "), "text")).over(w)
    h = t.conversations.select("conv_id", "turn", "role", F.array_join(prior, "\n\n").alias("instruction"), F.col("text").alias("response"))
    return h.where("role = 'assistant' and instruction <> '' and trim(response) <> ''").select("conv_id", "turn", "instruction", "response")


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END), ''), 'none') AS first FROM documents")
def alias_coalesce(t: Tables) -> DataFrame:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.documents.select("doc_id", F.coalesce(some(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source"))), some(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))), F.lit("none")).alias("first"))


@query("""
WITH c AS (SELECT conv_id, string_agg(substr(role, 1, 1), '' ORDER BY turn) AS roles, min(length(trim(text))) AS least FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN least = 0 THEN 'empty_message' WHEN NOT regexp_matches(roles, '^s?u') THEN 'no_user_first' WHEN regexp_matches(roles, 'uu|aa') THEN 'not_alternating' WHEN NOT regexp_matches(roles, 'a$') THEN 'no_final_answer' ELSE 'ok' END AS reason FROM c
""")
def chat_adapter(t: Tables) -> DataFrame:
    m = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: F.substring(x["role"], 1, 1)), "").alias("roles"), F.min(F.length(F.trim("text"))).alias("least"))
    r = F.col("roles")
    return c.select("conv_id", T.first_rule([(F.col("least") == 0, "empty_message"), (~r.rlike("^s?u"), "no_user_first"), (r.rlike("uu|aa"), "not_alternating"), (~r.rlike("a$"), "no_final_answer")], "ok").alias("reason"))


# Three-letter codes and names of the languages at hand.
ALIASES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "english": "en"}


@query("""
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'ger' ELSE 'xx' END ELSE lang END AS label FROM documents)
SELECT doc_id, CASE label WHEN 'eng' THEN 'en' WHEN 'fra' THEN 'fr' WHEN 'ger' THEN 'de' WHEN 'xx' THEN NULL ELSE label END AS resolved FROM l
""")
def lang_alias(t: Tables) -> DataFrame:
    label = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "ger").otherwise("xx")).otherwise(F.col("lang"))
    table = F.create_map(*(F.lit(x) for k, v in ALIASES.items() for x in (k, v)))
    known = F.coalesce(F.try_element_at(table, label), label)
    return t.documents.select("doc_id", F.when(known.isin("en", "fr", "de", "es"), known).alias("resolved"))


@query("SELECT doc_id, 'forward' AS direction, lang AS source_side, source AS target_side FROM documents UNION ALL SELECT doc_id, 'reverse', source, lang FROM documents")
def bidirectional_unpivot(t: Tables) -> DataFrame:
    both = F.array(F.struct(F.lit("forward").alias("direction"), F.col("lang").alias("source_side"), F.col("source").alias("target_side")), F.struct(F.lit("reverse").alias("direction"), F.col("source").alias("source_side"), F.col("lang").alias("target_side")))
    return t.documents.select("doc_id", F.inline(both))


@query("SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS answer FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0")
def nested_first(t: Tables) -> DataFrame:
    answers = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return t.documents.select("doc_id", F.trim(F.try_element_at(answers, F.lit(1))).alias("answer")).where("answer is not null")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key'), 'none') AS k FROM events")
def json_path(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key"), F.lit("none")).alias("k"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
f AS (SELECT *, CASE WHEN k = 1 OR (length(line) BETWEEN 1 AND 40 AND length(lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY k)) > 40) THEN 1 ELSE 0 END AS s FROM l),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM f)
SELECT doc_id, section::BIGINT AS section, min(CASE WHEN s = 1 THEN line END) AS heading, coalesce(string_agg(CASE WHEN s = 0 THEN line END, chr(10) ORDER BY k), '') AS body FROM i GROUP BY 1, 2
""")
def section_split(t: Tables) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("k")
    lines = t.documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("k", "line"))
    heading = (F.col("k") == 0) | (F.length("line").between(1, 40) & (F.length(F.lead("line", 1, "").over(w)) > 40))
    i = lines.withColumn("s", heading.cast("int")).withColumn("section", F.sum("s").over(w))
    rest = F.array_sort(F.collect_list(F.when(F.col("s") == 0, F.struct("k", "line"))))
    return i.groupBy("doc_id", "section").agg(F.min(F.when(F.col("s") == 1, F.col("line"))).alias("heading"), F.array_join(F.transform(rest, lambda x: x["line"]), "\n").alias("body"))


@query("SELECT event_id, event_type AS name, json(props)::VARCHAR AS arguments FROM events WHERE json_valid(props)")
def tool_call_parse(t: Tables) -> DataFrame:
    """JSON calls, with the arguments kept open as text."""
    raw = F.concat(F.lit('[{"name":"'), "event_type", F.lit('","arguments":'), "props", F.lit("}]"))
    calls = F.from_json(raw, "array<struct<name:string,arguments:string>>")
    return t.events.select("event_id", F.inline(calls))


@query("""
WITH f AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT c.conv_id, count(*) AS prompt_turns, string_agg(text, chr(10) ORDER BY turn) AS prompt FROM conversations c JOIN f ON c.conv_id = f.conv_id AND c.turn < f.a GROUP BY 1
""")
def preference_prefix(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    c = t.conversations.withColumn("a", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)).where("turn < a")
    return c.groupBy("conv_id").agg(F.count("*").alias("prompt_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("prompt"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), ''), nullif(regexp_extract(html, 'lang=\"([a-z]{2})\"', 1), ''), 'unknown') AS pair FROM pages")
def pair_infer(t: Tables) -> DataFrame:
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return t.pages.select("page_id", F.coalesce(found("url", "/(en|fr|de|es)/"), found("html", 'lang="([a-z]{2})"'), F.lit("unknown")).alias("pair"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'E%' THEN 'first' WHEN p_size > 40 THEN 'large' WHEN p_name LIKE '%1%' THEN 'one' ELSE 'other' END AS rule FROM part")
def first_match_rule(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.first_rule([(F.col("p_type").like("E%"), "first"), (F.col("p_size") > 40, "large"), (F.col("p_name").like("%1%"), "one")], "other").alias("rule"))


@query("SELECT doc_id, 'messages' AS view, text AS body FROM documents UNION ALL SELECT doc_id, 'reverse', reverse(text) FROM documents WHERE doc_id % 2 = 0")
def views_explode(t: Tables) -> DataFrame:
    views = F.array_compact(F.array(F.struct(F.lit("messages").alias("view"), F.col("text").alias("body")), F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("reverse").alias("view"), F.reverse("text").alias("body")))))
    return t.documents.select("doc_id", F.inline(views))


@query("""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN trim(x) = '' OR trim(y) = '' THEN 'empty' WHEN greatest(length(x), length(y)) >= 40 AND greatest(length(x), length(y)) > 3 * least(length(x), length(y)) THEN 'length_ratio'
  WHEN lower(x) = lower(y) THEN 'copy' WHEN regexp_matches(y, '[0-9]{6,}') THEN 'odd_number' ELSE 'accepted' END AS reason FROM p
""")
def rule_cascade(t: Tables) -> DataFrame:
    """A turn and the next stand for a pair of texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select("conv_id", "turn", F.col("text").alias("x"), F.lead("text").over(w).alias("y")).where("y is not null")
    x, y = F.col("x"), F.col("y")
    most, least = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    return p.select("conv_id", "turn", T.first_rule([((F.trim(x) == "") | (F.trim(y) == ""), "empty"), ((most >= 40) & (most > 3 * least), "length_ratio"), (F.lower(x) == F.lower(y), "copy"), (y.rlike("[0-9]{6,}"), "odd_number")], "accepted").alias("reason"))


@query("SELECT doc_id, k AS chunk, trim(substr(text, k * 1500 + 1, 1500)) AS body FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1499) // 1500)) AS k FROM documents) WHERE trim(substr(text, k * 1500 + 1, 1500)) <> ''")
def chunk_fixed(t: Tables) -> DataFrame:
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1500).cast("int")))
    pieces = F.transform(starts, lambda k: F.trim(F.substr(F.col("text"), k * 1500 + 1, F.lit(1500))))
    return t.documents.select("doc_id", F.posexplode_outer(pieces).alias("chunk", "body")).where("body <> ''").select("doc_id", F.col("chunk").cast("long").alias("chunk"), "body")


def boundary_cuts(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last paragraph or sentence end past the half, else at a space, else hard."""
    out = []
    while len(text) > most:
        head = text[:most]
        at = next((k + len(m) for m in ("\n\n", "\n", ". ", "! ", "? ") if (k := head.rfind(m)) > most // 2), 0) or head.rfind(" ") + 1 or most
        out.append(text[:at].strip())
        text = text[at:]
    return [x for x in [*out, text.strip()] if x]


@query(None)
def chunk_boundary(t: Tables) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: boundary_cuts(x or "", 1500))

    return t.documents.select("doc_id", F.posexplode_outer(cut("text")).alias("chunk", "body")).where("body is not null")


def packed(paragraphs: list[str], target: int, overlap: int) -> list[str]:
    """Paragraphs joined up to the target, the last ``overlap`` of one piece opening the next."""
    out, held = [], []
    for p in paragraphs:
        if held and sum(map(len, held)) + len(p) > target:
            out.append("\n".join(held))
            held = held[-overlap:] if overlap else []
        held.append(p)
    return [*out, "\n".join(held)] if held else out


@query(None)
def chunk_pack(t: Tables) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: packed([p for p in (x or "").split("\n") if p.strip()], 2000, 1))

    return t.documents.select("doc_id", F.posexplode_outer(cut("text")).alias("chunk", "body")).where("body is not null")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l, ('0x' || substr(sha256('window|' || doc_id), 1, 15))::BIGINT AS h FROM documents),
r AS (SELECT doc_id, l[(h % len(l) + 1):] AS l FROM d WHERE len(l) > 0),
w AS (SELECT doc_id, l, 0 AS k, '' AS body FROM r UNION ALL
  SELECT doc_id, l, k + 1, CASE WHEN length(body) + length(l[k + 1]) <= 1200 THEN body || l[k + 1] || chr(10) ELSE body END FROM w WHERE k < len(l))
SELECT doc_id, body FROM w WHERE k = len(l)
""")
def passage_window(t: Tables) -> DataFrame:
    """Lines from a hashed start on that fit into 1200 characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = t.documents.select("doc_id", lines.alias("l"), T.hash60(T.digest(F.lit("window"), "doc_id")).alias("h")).where(F.size("l") > 0)
    rest = F.slice("l", (F.col("h") % F.size("l") + 1).cast("int"), F.size("l"))
    body = F.aggregate(rest, F.lit(""), lambda a, x: F.when(F.length(a) + F.length(x) <= 1200, F.concat(a, x, F.lit("\n"))).otherwise(a))
    return d.select("doc_id", body.alias("body"))


@query(None)
def speech_windows(t: Tables) -> DataFrame:
    """Turns in order, packed greedily up to 2000 characters; windows under 200 go."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        pieces = [x for x in packed(rows["text"].dropna().tolist(), 2000, 0) if len(x) >= 200]
        out = pd.DataFrame({"conv_id": [rows["conv_id"].iloc[0]] * len(pieces), "k": range(len(pieces)), "body": pieces})
        return out.astype({"conv_id": "int64", "k": "int64", "body": "object"})  # also where no piece is left

    return t.conversations.groupBy("conv_id").applyInPandas(pack, "conv_id long, k long, body string")


@query(r"SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 80)) AS p FROM documents)")
def paragraphs(t: Tables) -> DataFrame:
    ps = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: F.length(x) >= 80)
    return t.documents.select("doc_id", F.explode_outer(ps).alias("paragraph")).where("paragraph is not null")


CUT = "(('0x' || substr(sha256('{0}|' || doc_id), 1, 15))::BIGINT % greatest(len(w) // 2, 1) + len(w) // 4)"


@query(f"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w, {CUT.format('cut')} AS k FROM d WHERE len(w) >= 8)
SELECT doc_id, array_to_string(w[1:k], ' ') AS prompt, array_to_string(w[k + 1:], ' ') AS continuation FROM c
""")
def prefix_continuation(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= 8)
    k = (T.hash60(T.digest(F.lit("cut"), "doc_id")) % F.greatest(F.floor(F.size("w") / 2), F.lit(1)) + F.floor(F.size("w") / 4)).cast("int")
    return c.withColumn("k", k).select("doc_id", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("prompt"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("continuation"))


@query(f"""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w, {CUT.format('span')} AS k FROM d WHERE len(w) >= 12)
SELECT doc_id, array_to_string(w[1:k], ' ') || ' <GAP> ' || array_to_string(w[k + 4:], ' ') AS prompt, array_to_string(w[k + 1:k + 3], ' ') AS span FROM c
""")
def span_fill(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= 12)
    k = (T.hash60(T.digest(F.lit("span"), "doc_id")) % F.greatest(F.floor(F.size("w") / 2), F.lit(1)) + F.floor(F.size("w") / 4)).cast("int")
    c = c.withColumn("k", k)
    return c.select("doc_id", F.concat(F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.lit(" <GAP> "), F.array_join(F.slice("w", F.col("k") + 4, F.size("w")), " ")).alias("prompt"), F.array_join(F.slice("w", F.col("k") + 1, F.lit(3)), " ").alias("span"))


@query("""
WITH n AS (SELECT doc_id, text, list_transform(string_split(text, ' '), lambda x, i: CASE ('0x' || substr(sha256('noise|' || doc_id || '|' || (i - 1)), 1, 15))::BIGINT % 20 WHEN 0 THEN '' WHEN 1 THEN x || ' ' || x ELSE x END) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x: x <> ''), ' ') AS corrupted, text AS target FROM n
""")
def denoise(t: Tables) -> DataFrame:
    """About a tenth of the words dropped or doubled, chosen by hashes of id and place."""
    w = F.split("text", " ")
    roll = lambda i: T.hash60(T.digest(F.lit("noise"), "doc_id", i)) % 20
    noisy = F.transform(w, lambda x, i: F.when(roll(i) == 0, "").when(roll(i) == 1, F.concat(x, F.lit(" "), x)).otherwise(x))
    return t.documents.select("doc_id", F.array_join(F.filter(noisy, lambda x: x != ""), " ").alias("corrupted"), F.col("text").alias("target"))


@query("""
WITH l AS (SELECT doc_id, list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40))[1:8] AS p FROM documents), n AS (SELECT doc_id, len(p) AS n FROM l WHERE len(p) >= 3)
SELECT doc_id, n FROM n
""")
def paragraph_reorder(t: Tables) -> DataFrame:
    ps = F.slice(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40)), 1, 8)
    d = t.documents.select("doc_id", ps.alias("p")).where(F.size("p") >= 3)
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct(F.sha2(F.concat(F.col("doc_id").cast("string"), i.cast("string")), 256).alias("h"), i.alias("i"))))
    order = F.transform(ranked, lambda x: x["i"])
    same = F.array_join(order, ",") == F.array_join(F.transform("p", lambda x, i: i), ",")
    order = F.when(same, F.concat(F.slice(order, F.lit(2), F.size(order)), F.slice(order, 1, 1))).otherwise(order)
    return d.select("doc_id", F.size(order).cast("long").alias("n"))
