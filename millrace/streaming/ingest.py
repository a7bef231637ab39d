"""Incremental ingest: clean each micro-batch and append the texts its domain doesn't have yet.

The seen texts are a table of their own, of hashes alone, written beside the kept records and divided by the first hex digits of the hash, so the
state is as durable as the output and grows on disk, not in memory. A micro-batch is compared with the parts its own hashes fall into; every
``COMPACT`` batches the table is written anew as one set of files, so what a batch reads is what there is, once, and not
a file for each batch before. Each micro-batch writes under its own id and overwrites it when it is repeated, and reads
only the hashes of other ids: a crash between write and checkpoint changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import clean_records, first_copies
from ..session import materialise

RAW = "raw binary, domain string, slot int, pos bigint"


#: Hex digits of the hash by which the seen texts are divided, and batches after which their table is compacted.
DIGITS, COMPACT = 2, 50
_SEEN = "domain string, sha string, batch bigint, part string"


def ingest_batch(batch: DataFrame, batch_id: int, out: str, config: DataFrame) -> None:
    """Keep one micro-batch: kept/batch=N has (domain, pos, text, sha), seen/ its hashes, dropped/batch=N the counts by reason."""
    spark = batch.sparkSession
    cleaned = materialise(clean_records(batch, config), "batch")
    fresh = first_copies(cleaned.where("reason is null").select("domain", "pos", "text")).withColumn("sha", F.sha2("text", 256))
    seen = seen_texts(spark, out)
    if seen is not None:
        # the parts a small batch needs are read alone; a large one needs all
        parts = [r[0] for r in fresh.select(F.substring("sha", 1, DIGITS)).distinct().collect()]  # 16 ** DIGITS at most
        before = seen.where(F.col("part").isin(parts) & (F.col("batch") != batch_id)).select("domain", "sha")
        fresh = fresh.join(before, ["domain", "sha"], "left_anti")
    fresh = materialise(fresh.select("domain", "pos", "text", "sha"), "fresh")
    fresh.write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")
    hashes = fresh.select("domain", "sha", F.lit(batch_id).cast("bigint").alias("batch"), F.substring("sha", 1, DIGITS).alias("part"))
    hashes.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/seen/run={batch_id}")
    drops = cleaned.where("reason is not null").groupBy("domain", "reason").agg(F.count("*").alias("n"))
    drops.write.mode("overwrite").parquet(f"{out}/dropped/batch={batch_id}")
    if batch_id % COMPACT == COMPACT - 1:
        compact(spark, out, batch_id)


def _runs(spark: SparkSession, out: str) -> list[str]:
    """The folders of the seen table; of a compaction and the runs it holds, the compaction alone."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/seen")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]
    last = max((int(n.split("=")[1]) for n in done if n.startswith("upto=")), default=-1)
    return [f"{out}/seen/{n}" for n in done if n == f"upto={last}" or (n.startswith("run=") and int(n.split("=")[1]) > last)]


def compact(spark: SparkSession, out: str, batch_id: int) -> None:
    """Write the hashes of all batches up to ``batch_id`` as one set of files; the runs it holds are read no more and removed by the next one."""
    jvm = spark.sparkContext._jvm
    fresh = _runs(spark, out)
    if f"{out}/seen/upto={batch_id}" in fresh:  # a batch that is repeated
        return
    seen_texts(spark, out).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/seen/upto={batch_id}")
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/seen")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(path):
        if f"{out}/seen/{s.getPath().getName()}" not in [*fresh, f"{out}/seen/upto={batch_id}"]:
            fs.delete(s.getPath(), True)


def seen_texts(spark: SparkSession, out: str) -> DataFrame | None:
    """(domain, sha, batch, part) of everything kept so far, or None."""
    runs = _runs(spark, out)
    if not runs:
        return None
    parts = [spark.read.schema(_SEEN).option("basePath", r).parquet(r).select("domain", "sha", "batch", "part") for r in runs]
    return reduce(DataFrame.unionByName, parts)


def _files(spark: SparkSession, source: str, files_per_batch: int, bytes_per_batch: int | None) -> DataFrame:
    """The stream of a folder's files; of a single file through its folder and a filter, as a stream needs a folder."""
    limit = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch)
    reader = spark.readStream.schema(RAW).option(*limit)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source)


def ingest(spark: SparkSession, source: str, out: str, config: DataFrame, files_per_batch: int = 100, interval: str | None = None, bytes_per_batch: int | None = None) -> StreamingQuery:
    """Start the ingest of the parquet files of raw records in ``source``, a folder or a file; all there is and then stop, or every ``interval``.

    A batch, the interval of checkpoints, has ``files_per_batch`` files or about ``bytes_per_batch`` bytes. Offsets and batch ids are in out/checkpoint, so a restart goes on where it stopped.
    """
    stream = _files(spark, source, files_per_batch, bytes_per_batch)
    writer = stream.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, out, config)).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
