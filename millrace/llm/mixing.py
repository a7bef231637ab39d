"""Problem 6: one mixture of several sources at target weights.

Each source's bytes are summed (partial aggregation, one row a source). The mixture is as large as it
can be while every source holds its share and no record is used more often than allowed: with the
least of ``max_repeats * bytes / share`` as its total, a source's rate is ``total * share / bytes``.
A record is emitted ``floor(rate)`` times, and once more if the hash of its id, seeded, falls under the
fraction of the rate. Emission needs no shuffle, so a source of any size is as parallel as the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources a target table may hold to be sent to every task; a longer table is joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def source_name(source: Column, record_id: Column) -> Column:
    """A source in its plain spelling: trimmed, lower case, ``_`` for blanks and hyphens; for null the id's part before the slash."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(source, F.substring_index(record_id, "/", 1)))), r"[\s-]+", "_")


def unit_hash(record_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), record_id)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def mixing_rates(records: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_bytes") -> DataFrame:
    """One row per target source: target_share, max_repeats, n_records, n_bytes, rate (null without records or share)."""
    have = records.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_records"), F.sum(size).cast("bigint").alias("n_bytes"))
    joined = (
        targets.select("source", "target_share", "max_repeats")
        .join(have, "source", "left")
        .withColumns({"n_records": F.coalesce("n_records", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0))})
    )
    most = F.when((F.col("n_bytes") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("n_bytes") / F.col("target_share"))
    total = joined.agg(F.min(most).alias("__total"))
    return joined.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        "n_records",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, F.least(F.col("max_repeats").cast("double"), F.col("__total") * F.col("target_share") / F.col("n_bytes"))).alias("rate"),
    )


def mix_to_targets(records: DataFrame, targets: DataFrame, record_id: str = "id", source: str = "source", size: str = "n_bytes", seed: int = 0) -> DataFrame:
    """``records`` with ``copy_no``: every record as often as its source's rate says.

    Records without a target, with a null or empty size, or of a source with share 0 aren't used;
    rows that are repeated in ``records`` count each (remove redelivered rows first); a null id draws 0.
    A column of the input named copy_no is replaced.
    """
    usable = records.where(F.col(size) > 0)
    rates = mixing_rates(usable, targets, source, size).where("rate > 0").select(F.col("source").alias("__s"), F.col("rate").alias("__rate"))
    if targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    whole = F.floor("__rate").cast("int")
    extra = (F.coalesce(unit_hash(F.col(record_id).cast("string"), seed), F.lit(0.0)) < F.col("__rate") - F.floor("__rate")).cast("int")
    return (
        usable.drop("copy_no")
        .join(rates, F.col(source) == F.col("__s"))
        .withColumn("__n", whole + extra)
        .where("__n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .drop("__s", "__rate", "__n")
    )


def mixture_report(mixed: DataFrame, records: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_bytes") -> DataFrame:
    """Per target source: target_share, reachable_share (over the sources with records), actual_share, rate, n_records, n_used, n_bytes_used."""
    used = mixed.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_used"), F.sum(size).cast("bigint").alias("n_bytes_used"))
    rates = mixing_rates(records.where(F.col(size) > 0), targets, source, size)
    both = rates.join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_used", "n_bytes_used")})
    total = both.agg(F.sum("n_bytes_used").alias("__b"), F.sum(F.when(F.col("n_bytes") > 0, F.col("target_share"))).alias("__t"))
    return both.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        F.when(F.col("n_bytes") > 0, F.col("target_share") / F.col("__t")).otherwise(F.lit(0.0)).alias("reachable_share"),
        F.coalesce(F.try_divide(F.col("n_bytes_used"), F.col("__b")), F.lit(0.0)).alias("actual_share"),
        "rate",
        "n_records",
        "n_used",
        "n_bytes_used",
    )
