"""Writers: corpus lines in rotated files, conversations, JSON beside them, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_line
from ..operators.running import running_sum

#: Fixed value: the size at which a file is closed, unless a single line is longer.
ROTATE_BYTES = 480 * 1024 * 1024


def file_numbers(lines: DataFrame, limit: int = ROTATE_BYTES, group: tuple[str, ...] = ("domain", "split")) -> DataFrame:
    """``lines`` with ``file_no``: consecutive files of about ``limit`` bytes (pos, line_bytes).

    A line goes to the file in which its first byte lies, so files are at most a line over the limit and
    can be numbered from the running sum alone, without walking through a domain in one task.
    """
    summed = running_sum(lines, list(group), ["pos"], "line_bytes", "__at")
    return summed.withColumn("file_no", F.floor(F.col("__at") / limit).cast("int")).drop("__at")


def write_corpus(records: DataFrame, path: str, compression: str = "none", limit: int = ROTATE_BYTES) -> None:
    """(text, source, id, domain, split, pos) as JSON lines under path/domain=/split=/file_no=, sorted by position in each file.

    The output committer makes the write atomic. ``compression``: none, gzip or bzip2.
    """
    line = json_line(F.col("text"), F.col("source"), F.col("id"))
    # sizes alone are ranged and summed; lines are joined to their files and moved there
    sized = records.select("domain", "split", "pos", (F.octet_length(line) + 1).cast("bigint").alias("line_bytes"))
    files = file_numbers(sized, limit).select(F.col("domain").alias("__d"), F.col("split").alias("__s"), F.col("pos").alias("__q"), "file_no")
    lines = records.select("domain", "split", "pos", line.alias("value"))
    numbered = lines.join(files, F.col("domain").eqNullSafe(F.col("__d")) & F.col("split").eqNullSafe(F.col("__s")) & (F.col("pos") == F.col("__q")))
    out = numbered.repartition("domain", "split", "file_no").sortWithinPartitions("domain", "split", "file_no", "pos")
    out.select("value", "domain", "split", "file_no").write.mode("overwrite").option("compression", compression).partitionBy("domain", "split", "file_no").text(path)


def write_conversations(samples: DataFrame, path: str, column: str = "messages") -> None:
    """One {"messages": [...]} line per row."""
    samples.select(F.to_json(F.struct(F.col(column).alias("messages"))).alias("value")).write.mode("overwrite").text(path)


def write_json(path: str | Path, value: dict) -> None:
    """A small JSON file, replaced as a whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_json(path: str | Path) -> dict | None:
    """A JSON file, or None if it isn't there or can't be read."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def is_current(want: dict, meta: dict | None) -> bool:
    """Whether a build's record has every wanted value."""
    return meta is not None and all(k in meta and meta[k] == v for k, v in want.items())


def check_run(meta: dict | None, **actual) -> dict:
    """The record of a build, if its values (fingerprint, vocabulary, shards, tokens, ...) are those found now."""
    if meta is None:
        raise ValueError("the build has no record")
    if wrong := {k: (meta.get(k), v) for k, v in actual.items() if meta.get(k) != v}:
        raise ValueError("the build doesn't fit: " + ", ".join(f"{k} is {v}, not {m}" for k, (m, v) in sorted(wrong.items())))
    return meta


def folder_bytes(spark, path: str) -> int:
    """Bytes of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def mix_report(rows: list[dict]) -> str:
    """A text table of a mixture: (domain, target_share, actual_share, tokens, documents)."""
    head = f"{'domain':<20}{'target':>9}{'actual':>9}{'diff':>10}{'tokens':>14}{'documents':>11}"
    body = [
        f"{r['domain']:<20}{r['target_share']:>9.2%}{r['actual_share']:>9.2%}{(r['actual_share'] - r['target_share']) * 100:>+8.2f}pp{r['tokens']:>14}{r['documents']:>11}"
        for r in sorted(rows, key=lambda r: r["domain"])
    ]
    return "\n".join([head, *body])
