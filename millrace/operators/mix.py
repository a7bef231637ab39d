"""Mixing domains to weights.

The rule "take next a document of the domain with the least produced tokens over weight, ties by name"
is a merge: every document has the key (tokens of its domain before it / weight, domain, position), and the
order of the mixture is the order of the keys. So the mixer is two running sums and a sort by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """``weights``, if there are some, all positive and of sum 1."""
    if not weights:
        raise ValueError("weights are empty")
    if bad := {d: w for d, w in weights.items() if not w > 0}:
        raise ValueError(f"weights must be positive: {bad}")
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights must sum to 1, not {sum(weights.values())}")
    return weights


def mix_order(docs: DataFrame, weights: dict[str, float], target: int | None = None) -> DataFrame:
    """The documents of the mixture with seq, mix_key, tokens_before and place.

    ``docs``: domain, pos, n_tokens (with everything that is credited). Documents are taken while fewer than
    ``target`` tokens are out; domains without weight are left out; a domain that runs dry drops out and the others go on.
    """
    placed = running_sums(_keyed(docs, weights), [], ["mix_key", "domain", "pos"], {"tokens_before": F.col("n_tokens"), "place": F.lit(1)})
    return placed if target is None else placed.where(F.col("tokens_before") < target)


def _weight_of(weights: dict[str, float]):
    table = F.create_map(*(x for d, w in weights.items() for x in (F.lit(d), F.lit(float(w)))))
    return table[F.col("domain")]


def _keyed(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The documents of domains with a weight, with mix_key."""
    check_weights(weights)
    own = docs.where(F.col("domain").isin(list(weights)))
    inside = running_sums(own, ["domain"], ["pos"], {"__produced": F.col("n_tokens")})
    return inside.withColumn("mix_key", F.col("__produced") / _weight_of(weights)).drop("__produced")


def credited(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs``, whose domains must all have a weight: a row of another one is an error when it is read."""
    known = F.col("domain").isin(list(check_weights(weights)))
    unknown = F.raise_error(F.concat(F.lit("no weight for domain "), F.coalesce(F.col("domain"), F.lit("null"))))
    return docs.withColumn("domain", F.when(F.coalesce(known, F.lit(False)), F.col("domain")).otherwise(unknown))


def check_totals(mixed: DataFrame, written: int) -> int:
    """The tokens of a mixture, if as many were written."""
    total = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if total != written:
        raise ValueError(f"the mixture has {total} tokens, but {written} were written")
    return total


def mix_stats(mixed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(domain, target_share, actual_share, diff_pp, tokens, documents), also for domains without documents."""
    spark = mixed.sparkSession
    names = F.broadcast(spark.createDataFrame(sorted(weights.items()), "domain string, target_share double"))
    have = mixed.groupBy("domain").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    out = names.join(have, "domain", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents")})
    total = F.broadcast(out.agg(F.sum("tokens").alias("__all")))  # one row
    share = F.coalesce(F.try_divide(F.col("tokens"), F.col("__all")), F.lit(0.0))
    return out.crossJoin(total).select("domain", "target_share", share.alias("actual_share"), ((share - F.col("target_share")) * 100).alias("diff_pp"), "tokens", "documents")


def exhausted(docs: DataFrame, weights: dict[str, float], target: int) -> DataFrame:
    """(domain): the domains that were asked for a document when they had none left, before the target was reached.

    The end of a domain is a row with the key (all its tokens / weight, domain), after its documents; it takes part in the mixture's running
    sum, and was asked for if the tokens before it leave the target unmet.
    """
    names = docs.sparkSession.createDataFrame([(d,) for d in check_weights(weights)], "domain string")
    sums = docs.groupBy("domain").agg(F.sum("n_tokens").alias("__t"))
    whole = F.coalesce("__t", F.lit(0)).cast("bigint")
    ends = names.join(sums, "domain", "left").select("domain", F.lit(1).alias("last"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n_tokens"), (whole / _weight_of(weights)).alias("mix_key"))
    rows = _keyed(docs.select("domain", "pos", "n_tokens"), weights).select("domain", F.lit(0).alias("last"), F.col("pos").cast("bigint").alias("pos"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "mix_key")
    placed = running_sums(rows.unionByName(ends), [], ["mix_key", "domain", "last", "pos"], {"before": F.col("n_tokens")})
    return placed.where((F.col("last") == 1) & (F.col("before") < target)).select("domain")
