"""Token streams laid out as shards, training windows and batches.

A document's place in the stream is a running sum of lengths; everything else is arithmetic on offsets, so shards and
windows are built where their tokens are, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums

#: Fixed value: the largest token id a shard can hold.
MAX_ID = 65_535


def stream_offsets(docs: DataFrame, order: list[str], n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with ``offset``, the tokens before each document."""
    return running_sums(docs, [], order, {"offset": F.col(n_tokens)})


def _cut(docs: DataFrame, size: int, ids: str, extra: int = 0) -> DataFrame:
    """(unit, at, part): slices of documents by unit of ``size`` tokens (and ``extra`` of the next), with their place in the stream."""
    first = F.floor(F.greatest(F.col("offset") - extra, F.lit(0)) / size).cast("bigint")
    last = F.floor((F.col("offset") + F.size(ids) - 1) / size).cast("bigint")
    spread = docs.where(F.size(ids) > 0).select("offset", ids, F.explode(F.sequence(first, last)).alias("unit"))
    lo = F.greatest(F.col("unit") * size, F.col("offset"))
    hi = F.least((F.col("unit") + 1) * size + extra, F.col("offset") + F.size(ids))
    part = F.slice(F.col(ids), (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    return spread.where(hi > lo).select("unit", lo.alias("at"), part.alias("part"))


def shards(docs: DataFrame, shard_tokens: int, ids: str = "ids") -> DataFrame:
    """(shard, n_tokens, tokens) of documents with ``offset`` and ids; ids out of 0..65535 are an error."""
    if shard_tokens < 1:
        raise ValueError("shard_tokens must be at least 1")
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    out = _cut(docs, shard_tokens, ids).groupBy(F.col("unit").alias("shard")).agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("tokens"))
    bad = F.exists("tokens", lambda t: (t < 0) | (t > MAX_ID))
    checked = F.when(bad, F.raise_error(F.lit("a token id is out of the range of 16 bits"))).otherwise(F.col("tokens"))
    return out.select("shard", F.size("tokens").alias("n_tokens"), checked.alias("tokens"))


def windows(docs: DataFrame, block: int, total: int, ids: str = "ids") -> DataFrame:
    """(block, input_ids, labels): window i has the tokens i*B .. i*B+B-1 and, as labels, those one further on.

    ``total`` is the length of the stream; it has ``(total - 1) // block`` windows, and fewer than one is an error.
    """
    if total < block + 1:
        raise ValueError(f"a stream of {total} tokens has no window of {block}")
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    whole = _cut(docs, block, ids, 1).groupBy(F.col("unit").alias("block")).agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("__t"))
    return whole.where(F.col("block") < (total - 1) // block).select(
        "block", F.slice("__t", 1, block).alias("input_ids"), F.slice("__t", 2, block).alias("labels")
    )


def window_at(docs: DataFrame, block: int, total: int, index: int, ids: str = "ids") -> DataFrame:
    """One window; negative indices count from the end, others out of range are an IndexError."""
    n = (total - 1) // block
    if not -n <= index < n:
        raise IndexError(f"window {index} of {n}")
    index %= n
    near = docs.where((F.col("offset") <= (index + 1) * block) & (F.col("offset") + F.size(ids) > index * block))
    return windows(near, block, total, ids).where(F.col("block") == index)


def batches(rows: DataFrame, place: str, size: int, drop_last: bool) -> DataFrame:
    """``rows`` with ``batch`` by their dense 0-based place; the short last batch goes if ``drop_last``."""
    out = rows.withColumn("batch", F.floor(F.col(place) / size).cast("bigint"))
    if not drop_last:
        return out
    n = F.broadcast(rows.agg(F.count("*").alias("__n")))  # one row
    return out.crossJoin(n).where(F.col("batch") < F.floor(F.col("__n") / size)).drop("__n")
