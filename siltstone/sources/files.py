"""Readers over file formats, and receipts of what was written."""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import ship, written


def scan(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet, ORC, CSV with a header, a JSON array, or JSON lines; what does not parse is an error."""
    bare = path.removesuffix(".gz")
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith(".orc"):
        return spark.read.orc(path)
    if bare.endswith(".csv"):
        return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return spark.read.option("multiLine", bare.endswith(".json")).option("mode", "FAILFAST").json(path)


def projected(df: DataFrame, families: list[list[str]]) -> DataFrame:
    """The first family of columns that the frame has whole; the rest is never read."""
    for columns in families:
        if set(columns) <= set(df.columns):
            return df.select(*columns)
    raise ValueError(f"no known family of columns in {df.columns}")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; what does not parse stays in ``_corrupt`` for counting."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def unpacked(raw: bytes) -> str:
    """The text of a file that may be compressed whatever its name says; told by its first bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return raw.decode("utf-8-sig")


def values(text: str, own_lines: bool = False) -> Iterator[object]:
    """The JSON values of a text one after another; with ``own_lines``, other data on a value's last line is an error."""
    decoder, at = json.JSONDecoder(strict=False), 0
    while at < len(text):
        if text[at].isspace():
            at += max(1, len(text[at : at + 4096]) - len(text[at : at + 4096].lstrip()))
            continue
        try:
            value, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise ValueError(f"an incomplete or broken JSON value at {at}") from e
        stop = text.find("\n", end)
        if own_lines and text[end : stop if stop >= 0 else len(text)].strip():
            raise ValueError(f"data after a JSON value at {end}")
        yield value
        at = end


def records(text: str) -> Iterator[dict]:
    """The records of a CSV with a header, a JSON array, or JSON values after one another, told by the first character."""
    head = text.lstrip()[:1]
    if head in ("[", "{"):
        for value in values(text):
            yield from value if isinstance(value, list) else [value]
    elif head:
        yield from csv.DictReader(io.StringIO(text, newline=""))


def _by_file(spark: SparkSession, path: str, read: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """``read`` over every file's bytes: a row (path, line) for each string it gives. A file is a row, so of 2 GB at most."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = read(raw)
                while part := list(islice(lines, 10000)):
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(part, pa.string())], names=["path", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line string")


def sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that may be compressed, and hold CSV, a JSON array or JSON values, whatever their names say."""
    fields = spark.createDataFrame([], schema).schema.fields
    found = _by_file(spark, path, lambda raw: (json.dumps(r, ensure_ascii=False) for r in records(unpacked(raw))))
    r = found.select(F.from_json("line", "map<string,string>").alias("r"))
    return r.select(*(F.try_element_at("r", F.lit(f.name)).cast(f.dataType).alias(f.name) for f in fields))


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects that run over several lines, one after another; a broken or incomplete one, or data after one on its line, is an error."""
    found = _by_file(spark, path, lambda raw: (json.dumps(v, ensure_ascii=False) for v in values(unpacked(raw), own_lines=True)))
    return found.select(F.from_json("line", schema).alias("r")).select("r.*")


def archived(files: DataFrame) -> DataFrame:
    """``files(path, content)``, zip archives, to ``(path, name, record)``: the JSON texts under ``samples/`` in order of name; other files have none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not zipfile.is_zipfile(io.BytesIO(raw)):
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = sorted(n for n in z.namelist() if n.startswith("samples/") and n.endswith(".json"))
                    while part := names[:1000]:
                        names = names[1000:]
                        yield pa.record_batch([pa.array([path] * len(part)), pa.array(part), pa.array([z.read(n).decode() for n in part])], names=["path", "name", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, record string")


# XML elements whose content goes, and those that stand on lines of their own.
XML_DROPPED = {"metadata", "media", "figure", "note"}
XML_BLOCKS = {"document", "title", "section", "para", "list", "item"}


def xml_plain(xml: str) -> str:
    """The running text of an XML document, by a walk of its tree in document order."""
    out: list[str] = []
    hidden = 0
    # text and tail are there only when the whole tree is
    for event, node in list(ElementTree.iterparse(io.StringIO(xml), ("start", "end"))):
        tag = node.tag.rsplit("}", 1)[-1]
        if event == "start":
            hidden += tag in XML_DROPPED
            if not hidden:
                out.append(("\n" if tag in XML_BLOCKS else "") + ("- " if tag == "item" else "") + (node.text or ""))
        else:
            if not hidden and tag in XML_BLOCKS:
                out.append("\n")
            hidden -= tag in XML_DROPPED
            if not hidden:
                out.append(node.tail or "")
    text = re.sub(r"[ \t\u00a0]+", " ", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def numbered(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Lines with their number from 0, in the order of the files' names and of the lines in them.

    Blocks of files are read apart: the lines of the blocks before are
    counted, and in a block the reader's own order counts on.
    """
    lines = spark.read.text(path).select(F.col("value").alias(column), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    lines = written(lines, "lines")
    blocks = lines.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    blocks = blocks.select("__file", "__block", "__first", before.alias("__before"))
    return lines.join(blocks, ["__file", "__block"]).select((F.col("__before") + F.col("__row") - F.col("__first")).alias("n"), column)


def zipped(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Lines of two texts side by side; unequal counts are an error."""
    both = numbered(spark, left, "x").join(numbered(spark, right, "y"), "n", "full")
    even = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.select("n", F.when(even, F.col("x")).otherwise(F.raise_error(F.lit("the files differ in length")).cast("string")).alias("x"), "y")


def signature(options: str = "", size: str = "length", changed: str = "modificationTime") -> Column:
    """What a conversion depends on: a file's size, its time, and the converter's options."""
    return F.sha2(F.concat_ws("|", F.col(size).cast("string"), F.unix_micros(changed).cast("string"), F.lit(options)), 256)


def receipt(spark: SparkSession, path: str) -> DataFrame:
    """``(name, bytes, sha256)`` of a folder's data files, each of 2 GB at most."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return f.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def signatures(spark: SparkSession, path: str, options: str = "") -> DataFrame:
    """``(path, signature)`` of a folder's data files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", signature(options).alias("signature"))


def changed(spark: SparkSession, path: str, manifest: DataFrame, options: str = "") -> DataFrame:
    """Files whose signature the manifest lacks."""
    return signatures(spark, path, options).join(manifest, ["path", "signature"], "left_anti")
