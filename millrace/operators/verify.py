"""Invariant checks over a finished corpus: each is one aggregate, all are one table (check, ok, bad, n).

``ok`` is null for a check that doesn't apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import MIN_DOC_BYTES, small

#: The limits of the checks.
MAX_FILE_BYTES, SHARE_TOLERANCE_PP, SMOKE_BYTES = 512 * 1024**2, 5.0, (30_000_000, 80_000_000)
KEYS = ("id", "source", "text")


def _row(df: DataFrame, check: str, bad: Column, n: Column) -> DataFrame:
    return df.agg(F.coalesce(bad, F.lit(0)).cast("bigint").alias("bad"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(
        F.lit(check).alias("check"), (F.col("bad") == 0).alias("ok"), "bad", "n"
    )


def check_records(records: DataFrame, config: DataFrame) -> DataFrame:
    """Checks C3 to C8 over records (text, source, id, split, domain), domain being the directory a record lies in.

    C3 source differs from the domain; C4 rows beyond the distinct ids; C5 ids in train and val of a domain; C6 a null text, CR or
    NUL; C7 fewer bytes than the domain's minimum; C8 texts beyond the distinct ones of a domain.
    """
    least = config.select(F.col("domain").alias("__d"), F.col("min_doc_bytes").alias("__min"))
    joined = records.join(small(least), F.col("domain") == F.col("__d"), "left")
    size = F.octet_length("text")
    flags = joined.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("source").eqNullSafe(F.col("domain"))).alias("C3"),
        F.count_if(F.col("text").isNull() | F.contains("text", F.lit("\r")) | F.contains("text", F.lit("\x00"))).alias("C6"),
        F.count_if(size < F.coalesce("__min", F.lit(MIN_DOC_BYTES))).alias("C7"),
    )
    simple = flags.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("bad")) for c in ("C3", "C6", "C7")))))
    simple = simple.select("check", (F.col("bad") == 0).alias("ok"), "bad", "n")
    # per id and per text first, with map-side parts; a hot text is one group of partial counts
    per_id = records.groupBy("id").agg(F.count("*").alias("k"))
    ids = _row(per_id, "C4", F.sum("k") - F.count("id"), F.sum("k"))
    sides = records.groupBy("domain", "id").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") == "val").alias("v"))
    both = _row(sides, "C5", F.count_if(F.col("t") & F.col("v")), F.count("*"))
    per_text = records.where(F.col("text").isNotNull()).groupBy("domain", F.sha2(F.col("text"), 256).alias("h")).agg(F.count("*").alias("k"))
    texts = _row(per_text, "C8", F.sum(F.col("k") - 1), F.sum("k"))
    return reduce(DataFrame.unionByName, [simple, ids, both, texts])


def check_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Check C2: every non-blank line is an object with exactly the three keys."""
    keys = F.json_object_keys(F.col(value))
    bad = keys.isNull() | (F.concat_ws(",", F.array_sort(keys)) != ",".join(KEYS))
    return _row(lines.where(F.trim(F.col(value)) != ""), "C2", F.count_if(bad), F.count("*"))


def check_shares(sizes: DataFrame, config: DataFrame) -> DataFrame:
    """Check C9: each built domain's (domain, bytes) share within 5 points of its target, renormalised over built ones; no domain: null."""
    built = sizes.where("bytes > 0").join(config.select("domain", "share"), "domain")
    whole = built.agg(F.sum("bytes").alias("__b"), F.sum("share").alias("__s"))
    off = F.abs(F.col("bytes") / F.col("__b") - F.col("share") / F.col("__s")) * 100 > SHARE_TOLERANCE_PP
    out = _row(built.crossJoin(F.broadcast(whole)), "C9", F.count_if(off), F.count("*"))  # one row
    return out.withColumn("ok", F.when(F.col("n") > 0, F.col("ok")))


def check_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Checks C1, C10 and C11 over files (domain, name, bytes) and a manifest (domain, bytes, status).

    C1 unblocked domains without a train or a val file; C10 files above 512 MiB; C11 domains whose bytes differ.
    """
    kinds = files.groupBy("domain").agg(
        F.bool_or(F.startswith("name", F.lit("train_"))).alias("t"), F.bool_or(F.startswith("name", F.lit("val_"))).alias("v"), F.sum("bytes").alias("disk")
    )
    both = manifest.where("status <> 'blocked'").join(kinds, "domain", "full_outer")
    present = F.coalesce(F.col("t") & F.col("v"), F.lit(False))
    c1 = _row(both.where("status is not null"), "C1", F.count_if(~present), F.count("*"))
    c10 = _row(files, "C10", F.count_if(F.col("bytes") > MAX_FILE_BYTES), F.count("*"))
    c11 = _row(both, "C11", F.count_if(~F.col("bytes").eqNullSafe(F.col("disk"))), F.count("*"))
    return c1.unionByName(c10).unionByName(c11)


def check_smoke(corpus: DataFrame, smoke: DataFrame) -> DataFrame:
    """Check C12: the smoke corpus has the domains of the corpus (domain, bytes) and 30 to 80 MB."""
    both = corpus.select("domain").distinct().withColumn("c", F.lit(True)).join(smoke.select("domain", "bytes"), "domain", "full_outer")
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    out_of_size = F.when((total < SMOKE_BYTES[0]) | (total > SMOKE_BYTES[1]), 1).otherwise(0)
    return _row(both, "C12", F.count_if(F.col("c").isNull() | F.col("bytes").isNull()) + out_of_size, F.count("*"))
