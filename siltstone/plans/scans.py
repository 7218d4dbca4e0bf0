"""Scans, sources, sinks (survey 2.A)."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.operators import relational as R
from siltstone.registry import Tables, query
from siltstone.session import ship, table_path, written
from siltstone.sources import files


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def scan_parquet(t: Tables) -> DataFrame:
    return files.scan(t.spark, f"{t.folder}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents")
def scan_projection(t: Tables) -> DataFrame:
    return files.projected(t.documents, [["condition", "instruction", "response"], ["messages"], ["doc_id", "lang"]])


@query("SELECT source, max(ordinal) AS last FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents) GROUP BY source")
def scan_with_ordinal(t: Tables) -> DataFrame:
    """The place of a row in its source; a stated order, never the reader's."""
    placed = R.prefix(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], R.by_value("doc_id"), F.lit(1), "ordinal")
    return placed.groupBy("source").agg(F.max("ordinal").alias("last"))


@query("""
WITH s AS (SELECT doc_id, lang, dense_rank() OVER (ORDER BY doc_id // 1000) - 1 AS shard FROM documents) SELECT 's' || shard || ':' || doc_id AS id, lang FROM s
""")
def scan_shard_ids(t: Tables) -> DataFrame:
    """Zip archives of a thousand samples each, read back; an archive's place in the list of archives keeps equal ids apart."""
    ship(t.spark)

    @F.pandas_udf("binary")
    def packed(samples: pd.Series) -> pd.Series:
        def one(rows: list) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for r in rows:
                    z.writestr(f"samples/{r['doc_id']}.json", json.dumps({"id": int(r["doc_id"]), "lang": r["lang"]}))
                z.writestr("header.json", "{}")
            return out.getvalue()

        return samples.map(one)

    shards = t.documents.groupBy(F.floor(F.col("doc_id") / 1000).alias("shard")).agg(F.collect_list(F.struct("doc_id", "lang")).alias("samples"))  # 1000 samples each
    files_ = written(shards.select(F.format_string("%019d.eval", "shard").alias("path"), packed("samples").alias("content")), "archives")
    order = files_.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("place"))  # a row for each archive
    found = files.archived(files_).join(order, "path")
    record = F.from_json("record", "id string, lang string")
    return found.select("place", record.alias("r")).select(F.concat(F.lit("s"), F.col("place").cast("string"), F.lit(":"), F.col("r.id")).alias("id"), "r.lang")


KEY = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query(rf"""
WITH d AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, unnest(list_distinct(list_transform(list_concat(l[1:4], l[greatest(len(l) - 3, 1):]), lambda x: {KEY.format('x')}))) AS k FROM d),
n AS (SELECT source, greatest(3, count(*) // 3) AS least FROM documents GROUP BY source),
r AS (SELECT e.source, k FROM e JOIN n USING (source) WHERE length(k) BETWEEN 5 AND 160 GROUP BY e.source, k HAVING count(*) >= max(least)),
s AS (SELECT source, list(k) AS ks FROM r GROUP BY source)
SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT coalesce(list_contains(ks, {KEY.format('x')}), false) AND NOT regexp_full_match({KEY.format('x')}, '(side|page)?\s*[0-9]+')), chr(10)) AS body
FROM d LEFT JOIN s USING (source)
""")
def repeated_line_removal(t: Tables) -> DataFrame:
    """Documents are the pages of their source: lines among the first or last four of a third of its pages, three at least, go, as do page numbers."""
    return without_running_heads(t.documents.select("doc_id", "source", "text"))


def without_running_heads(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, source, text)`` to ``(doc_id, body)``; at most 24 lines of a source can be on a third of its pages."""
    key = lambda x: F.lower(T.collapse(x))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = pages.select("doc_id", "source", lines.alias("l"))
    edges = F.array_distinct(F.transform(F.concat(F.slice("l", 1, 4), F.slice("l", F.greatest(F.size("l") - 3, F.lit(1)), F.lit(4))), key))
    seen = d.select("source", F.explode_outer(edges).alias("k")).where(F.length("k").between(5, 160)).groupBy("source", "k").agg(F.count("*").alias("pages"))
    least = pages.groupBy("source").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 3)).alias("least"))
    heads = seen.join(least, "source").where("pages >= least").groupBy("source").agg(F.collect_set("k").alias("ks"))
    stays = lambda x: ~F.coalesce(F.array_contains("ks", key(x)), F.lit(False)) & ~key(x).rlike(r"^(side|page)?\s*[0-9]+$")
    return d.join(heads, "source", "left").select("doc_id", F.array_join(F.filter("l", stays), "\n").alias("body"))


def _saved(df: DataFrame, name: str, kind: str, **options: str) -> str:
    path = table_path(df.sparkSession, name)
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT count(*) AS good, 1::BIGINT AS bad FROM documents")
def scan_json_permissive(t: Tables) -> DataFrame:
    """JSON lines among them one that does not parse, which is counted and left out."""
    good = t.documents.select(F.to_json(F.struct("doc_id", "lang")).alias("value"))
    path = _saved(good.union(t.spark.createDataFrame([('{"doc_id": 1, "lang"',)], "value string")), "jsonl", "text")
    return files.json_lines(t.spark, path, "doc_id long, lang string").agg(F.count_if(F.col("_corrupt").isNull() & F.col("doc_id").isNotNull()).alias("good"), F.count_if(F.col("_corrupt").isNotNull()).alias("bad"))


@query("SELECT doc_id, lang FROM documents")
def scan_json_multiline(t: Tables) -> DataFrame:
    """Objects of several lines, one after another in a file."""
    rows = t.documents.select(F.concat(F.lit("{\n \"doc_id\": "), F.col("doc_id").cast("string"), F.lit(",\n \"lang\": \""), "lang", F.lit("\"}")).alias("value"))
    return files.objects(t.spark, _saved(rows, "objects", "text"), "doc_id long, lang string")


@query("SELECT doc_id, source FROM documents")
def scan_sniff(t: Tables) -> DataFrame:
    """Compressed and plain files of JSON lines, JSON arrays and CSV, told by their content."""
    d = t.documents.select("doc_id", "source")
    part = lambda k: d.where(F.pmod("doc_id", F.lit(3)) == k)
    arrays = part(1).groupBy(F.floor(F.col("doc_id") / 3000)).agg(F.to_json(F.collect_list(F.struct("doc_id", "source"))).alias("value")).select("value")  # 1000 rows each
    paths = [_saved(part(0), "packed", "json", compression="gzip"), _saved(arrays, "arrays", "text"), _saved(part(2), "csv", "csv", header="true", compression="gzip")]
    found = [files.sniffed(t.spark, p, "doc_id long, source string") for p in paths]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT doc_id, lang, source FROM documents")
def scan_zip_aligned(t: Tables) -> DataFrame:
    """Two texts line by line; their line counts must agree."""
    d = t.documents.select("doc_id", "lang", "source").orderBy("doc_id")
    left = _saved(d.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "lang").alias("value")), "left", "text")
    right = _saved(d.select(F.col("source").alias("value")), "right", "text")
    both = files.zipped(t.spark, left, right)
    parts = F.split("x", "\t")
    return both.select(parts[0].cast("long").alias("doc_id"), parts[1].alias("lang"), F.col("y").alias("source"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def csv_roundtrip(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    path = _saved(d, "csv", "csv", header="true")
    return t.spark.read.schema(d.schema).option("header", True).option("enforceSchema", False).csv(path)


@query("SELECT 'direct' AS condition, trim(substr(text, 1, 20)) AS instruction, trim(text) AS response FROM documents WHERE trim(text) <> ''")
def sink_parquet(t: Tables) -> DataFrame:
    d = t.documents.select(F.lit("direct").alias("condition"), F.trim(F.substring("text", 1, 20)).alias("instruction"), F.trim("text").alias("response")).where("response <> ''")
    return t.spark.read.parquet(_saved(d, "triples", "parquet", compression="zstd"))


@query("SELECT doc_id, lang FROM documents")
def sink_sharded(t: Tables) -> DataFrame:
    path = _saved(t.documents.select("doc_id", "lang"), "shards", "json", compression="gzip", maxRecordsPerFile="200")
    return t.spark.read.schema("doc_id long, lang string").json(path)


@query(None)
def sink_receipt(t: Tables) -> DataFrame:
    """A receipt of what was written: files, sizes and digests."""
    return files.receipt(t.spark, _saved(t.documents.select("doc_id", "lang"), "out", "parquet"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def incremental_scan(t: Tables) -> DataFrame:
    """Even documents are in the manifest; of the files that come later only the new ones, the odd documents, are read."""
    path = _saved(t.documents.where("doc_id % 2 = 0").select("doc_id"), "in", "parquet")
    manifest = written(files.signatures(t.spark, path, "version 1"), "manifest")
    t.documents.where("doc_id % 2 = 1").select("doc_id").write.mode("append").parquet(path)
    new = files.changed(t.spark, path, manifest, "version 1").select("path")
    rows = t.spark.read.schema("doc_id long").parquet(path).select("doc_id", F.col("_metadata.file_path").alias("path"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return rows.join(new.select(plain("path").alias("new")), plain("path") == F.col("new"), "left_semi").select("doc_id")


@query("""
WITH d AS (SELECT doc_id, length(text) // 3 AS inst_len, length(text) - length(text) // 3 AS resp_len, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS inst_start FROM documents)
SELECT doc_id, inst_start, inst_len, inst_start + inst_len AS resp_start, resp_len FROM d
""")
def token_store(t: Tables) -> DataFrame:
    """Where each example's instruction and response lie in one flat store, in order of doc_id; code points stand for ids, and the first third is the instruction."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    d = R.prefix(t.documents.select("doc_id", n.alias("n")), [], ["doc_id"], R.by_value("doc_id"), F.col("n"), "inst_start")
    inst = F.floor(F.col("n") / 3)
    return d.select("doc_id", "inst_start", inst.alias("inst_len"), (F.col("inst_start") + inst).alias("resp_start"), (F.col("n") - inst).alias("resp_len"))


@query("SELECT event_id AS step, value AS loss FROM events")
def scan_history(t: Tables) -> DataFrame:
    d = t.events.select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    path = _saved(d, "history", "json")
    return files.json_lines(t.spark, path, "step long, loss double").where("_corrupt is null").drop("_corrupt")


@query("SELECT source AS task, count(*) AS rows_n, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY source")
def md_table_scan(t: Tables) -> DataFrame:
    """A pipe table of one section of a report, read back."""
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    lines = g.select(F.concat(F.lit("| "), "source", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("s").cast("string"), F.lit(" |")).alias("value"))
    path = _saved(lines, "report", "text")
    cells = F.split("value", r"\|")
    rows = t.spark.read.text(path).where(F.col("value").rlike(r"^\| *src"))
    return rows.select(F.trim(cells[1]).alias("task"), F.trim(cells[2]).cast("long").alias("rows_n"), F.trim(cells[3]).cast("long").alias("tokens"))


CLEAN = r"trim(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{{FFFE}}\x{{FFFF}}]', ' ', 'g'), '[ \t\x{{A0}}]+', ' ', 'g'))"


@query(rf"""
WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {CLEAN.format('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_concat([source], l), chr(10) || chr(10)) AS body FROM l
""")
def xml_text(t: Tables) -> DataFrame:
    """The running text of XML documents: titles and paragraphs on lines of their own, notes left out."""
    ship(t.spark)

    @F.pandas_udf("string")
    def plain(xml: pd.Series) -> pd.Series:
        return xml.map(files.xml_plain)

    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = lambda x: F.regexp_replace(x, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}]", " ")
    paras = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<para>"), safe(clean(x)), F.lit("<note>left out</note></para>"))), "")
    xml = F.concat(F.lit('<document xmlns="urn:x"><metadata>none</metadata><title>'), safe(F.col("source")), F.lit("</title><content>"), paras, F.lit("</content></document>"))
    return t.documents.select("doc_id", plain(xml).alias("body"))


@query("SELECT a.doc_id FROM documents a")
def aligned_join(t: Tables) -> DataFrame:
    """Row i of two texts carries the same id, or the scan fails."""
    d = t.documents.select("doc_id").orderBy("doc_id").select(F.col("doc_id").cast("string").alias("value"))
    both = files.zipped(t.spark, _saved(d, "a", "text"), _saved(d, "b", "text"))
    same = F.when(F.col("x") == F.col("y"), F.col("x").cast("long")).otherwise(F.raise_error(F.lit("rows are not aligned")).cast("long"))
    return both.select(same.alias("doc_id"))
