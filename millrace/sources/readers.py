"""Readers: parquet, JSON lines (strict and lenient), documentation trees, trajectories, conversations."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_partition

#: Splits of text files whose first line numbers are sent to every task; more are joined by shuffle.
MAX_SPLITS = 200_000
RECORD = "text string, source string, id string"
MESSAGES = (
    "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"
)


class SourceUnavailable(Exception):
    """A source that can't be read as specified: why, and what to do. It is reported, never replaced."""

    def __init__(self, reason: str, action: str) -> None:
        super().__init__(reason)
        self.reason, self.action = reason, action


def probe(df: DataFrame, text: str) -> DataFrame:
    """``df``, if it has a string column ``text`` and a row."""
    fields = {f.name: f.dataType for f in df.schema}
    if text not in fields:
        raise SourceUnavailable(f"no column {text!r}, but {sorted(fields)}", "set the text column of the source")
    if not isinstance(fields[text], T.StringType):
        raise SourceUnavailable(f"column {text!r} is {fields[text].simpleString()}", "choose a string column")
    if df.isEmpty():
        raise SourceUnavailable("the source is empty", "check its path and split")
    return df


def read_parquet(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(raw, file, row) of a parquet source; only the text column is read, (file, row) is the stream position."""
    df = spark.read.parquet(path)
    return probe(df, text).select(F.col(text).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file) of text files, split at LF only; bzip2 and gzip by suffix."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``read_lines`` with ``line``, the number of each line in its file, from 1.

    Every split counts its lines first; a line's number is its place in its split and the lines of the file's earlier splits.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    splits = rows.groupBy("file", "__b").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "__b", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    small = F.broadcast(splits) if splits.limit(MAX_SPLITS + 1).count() <= MAX_SPLITS else splits
    return rows.join(small, ["file", "__b"]).select("value", "file", (F.col("__before") + F.col("__m") - F.col("__first") + 1).alias("line"))


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of zstandard files: each file is decompressed as a stream by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import zstandard

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines: list[str] = []
                size = 0
                for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)), encoding="utf-8", newline="\n"):
                    lines.append(line.rstrip("\n"))
                    size += len(line)
                    if size > 4_000_000:
                        yield {"value": lines, "file": [name] * len(lines)}
                        lines, size = [], 0
                if lines:
                    yield {"value": lines, "file": [name] * len(lines)}

    return map_partition(files, run, "value string, file string")


def lenient(lines: DataFrame, text: str = "text") -> DataFrame:
    """The text field of the lines; blank and malformed lines and null texts are passed over."""
    parsed = F.from_json("value", f"`{text}` string", {"mode": "PERMISSIVE"})
    return lines.where(F.trim("value") != "").select(parsed[text].alias("raw")).where("raw is not null")


def strict(lines: DataFrame, where: Column) -> DataFrame:
    """``lines`` with text; a malformed line, or a text that is missing, empty or no string, is an error that names ``where``, as file:line.

    Blank lines are passed over.
    """
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(variant, "$.text", "variant"))
    text = F.try_variant_get(variant, "$.text", "string")
    good = variant.isNotNull() & (kind == "STRING") & (F.coalesce(text, F.lit("")) != "")
    problem = F.when(variant.isNull(), "malformed line").otherwise("no text")
    checked = F.when(F.coalesce(good, F.lit(False)), text).otherwise(F.raise_error(F.concat(where, F.lit(": "), problem)))
    return lines.where(F.btrim("value", F.lit(" \t\r\n")) != "").withColumn("text", checked)


def corpus_files(spark: SparkSession, root: str, domain: str, split: str) -> list[str]:
    """The sorted JSON-lines files of a split, on any file system, found before a job starts."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{domain}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(pattern: str) -> list[str]:
        return sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, pattern)) or [])

    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        raise FileNotFoundError(f"no folder {folder}")
    if files := found(f"{split}_*.jsonl"):
        return files
    if found(f"{split}_*.jsonl.zst"):
        raise FileNotFoundError(f"{folder} has only compressed {split} files; decompress them or use read_zstd_lines")
    raise FileNotFoundError(f"{folder} has no {split} files")


def _place() -> Column:
    return F.concat("file", F.lit(":"), F.col("line").cast("string"))


def read_corpus(spark: SparkSession, root: str, domain: str, split: str) -> DataFrame:
    """(text, source, id, file) of a domain's split, read strictly."""
    lines = strict(numbered_lines(spark, corpus_files(spark, root, domain, split)), _place())
    rest = F.from_json("value", "source string, id string")
    return lines.select("text", rest["source"].alias("source"), rest["id"].alias("id"), "file")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(messages, file) of SFT lines; a line without a non-empty message list is an error."""
    lines = numbered_lines(spark, path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    messages = F.from_json("value", f"messages {MESSAGES}")["messages"]
    ok = F.coalesce(F.size(messages), F.lit(0)) > 0
    return lines.select(F.when(ok, messages).otherwise(F.raise_error(F.concat(_place(), F.lit(": no messages")))).alias("messages"), "file")


_OVERSTRIKE = ".\x08"


def read_docs(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(raw, file) of a tree of documentation files, in the order of their paths; overstrikes of rendered pages are removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    plain = F.regexp_replace(F.when(valid, F.col("content").cast("string")), _OVERSTRIKE, "").cast("binary")
    return files.select(F.coalesce(plain, "content").alias("raw"), F.col("path").alias("file")).orderBy("file")


def open_source(spark: SparkSession, kind: str, path: str, text: str = "text") -> DataFrame:
    """A source by kind: parquet, jsonl, jsonl.zst or docs."""
    if kind == "parquet":
        return read_parquet(spark, path, text)
    if kind == "jsonl":
        return lenient(read_lines(spark, path), text)
    if kind == "jsonl.zst":
        return lenient(read_zstd_lines(spark, path), text)
    if kind == "docs":
        return read_docs(spark, path)
    raise TypeError(f"unknown kind of source: {kind}")


def first_available(spark: SparkSession, candidates: list[tuple[str, str, str]]) -> tuple[DataFrame | None, list[SourceUnavailable]]:
    """The first (kind, path, text) of a slot that can be read, and what was wrong with those before."""
    failures: list[SourceUnavailable] = []
    for kind, path, text in candidates:
        try:
            return open_source(spark, kind, path, text), failures
        except SourceUnavailable as e:
            failures.append(e)
        except Exception as e:  # noqa: BLE001 - a path that isn't there is an AnalysisException
            failures.append(SourceUnavailable(str(e)[:300], "check the path"))
    return None, failures


_SESSION, _REWARD = re.compile(r"(.*)/agent/[^/]*session\.json$"), re.compile(r"(.*)/verifier/reward\.txt$")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, trial, part, content): the session and reward members of trajectory archives (tar.gz), one task an archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                    for member in tar:
                        for part, pattern in (("session", _SESSION), ("reward", _REWARD)):
                            if m := pattern.match(member.name):
                                text = tar.extractfile(member).read().decode("utf-8", "replace")
                                yield {"archive": [name], "trial": [m.group(1)], "part": [part], "content": [text]}

    return map_partition(files, run, "archive string, trial string, part string, content string")


def successful(members: DataFrame) -> DataFrame:
    """(archive, trial, messages, verdict) of every session: "kept" with reward 1 and readable messages, else "failed"."""
    sessions = members.where("part = 'session'").select("archive", "trial", F.col("content").alias("session"))
    rewards = members.where("part = 'reward'").select("archive", "trial", F.col("content").alias("reward"))
    messages = F.from_json("session", MESSAGES)
    joined = sessions.join(rewards, ["archive", "trial"], "left").withColumn("messages", messages)
    ok = (F.btrim("reward", F.lit(" \t\r\n")) == "1") & F.col("messages").isNotNull()
    return joined.select("archive", "trial", F.when(ok, F.col("messages")).alias("messages"), F.when(ok, "kept").otherwise("failed").alias("verdict"))
