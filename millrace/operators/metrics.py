"""Evaluation metrics, schedules and training logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chat import IGNORE

#: The lines of a training log.
LOG_LINE = r"step\s+(\d+).*?train loss = ([\d.]+).*?val loss = ([\d.]+).*?bpb = ([\d.]+)"
LOG_END = r"\[epoch end\].*?step\s+(\d+).*?val loss = ([\d.]+).*?bpb = ([\d.]+)"


def evaluate(scored: DataFrame, token_bytes: DataFrame) -> DataFrame:
    """(loss, bpb, n_tokens, n_bytes) of scored tokens (label, nll) and the bytes of each token (label, n_bytes).

    Ignored labels don't count; without bytes bpb is NaN, without tokens loss is null.
    """
    rows = scored.where(F.col("label") != IGNORE).join(token_bytes, "label", "left")
    out = rows.agg(F.sum("nll").alias("__s"), F.count("*").alias("n_tokens"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"))
    bpb = F.when(F.col("n_bytes") > 0, F.col("__s") / math.log(2) / F.col("n_bytes")).otherwise(F.lit(float("nan")))
    return out.select(F.try_divide(F.col("__s"), F.col("n_tokens")).alias("loss"), bpb.alias("bpb"), "n_tokens", "n_bytes")


def learning_rate(step: Column, base: float, warmup: int, total: int, least_ratio: float) -> Column:
    """Linear warm-up, then a cosine down to ``base * least_ratio``."""
    if total <= warmup:
        raise ValueError("the schedule must be longer than its warm-up")
    low = base * least_ratio
    done = (step - warmup) / (total - warmup)
    wave = F.lit(low) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * done)) * F.lit(base - low)
    return F.when(step < warmup, F.lit(base) * (step + 1) / warmup).when(step >= total, F.lit(low)).otherwise(wave)


def schedule(total_tokens: int, tokens_per_step: int, warmup_ratio: float) -> tuple[int, int]:
    """(steps, warm-up steps)."""
    steps = max(2, total_tokens // tokens_per_step)
    return steps, max(1, min(int(steps * warmup_ratio), steps - 1))


def accumulation(tokens_per_step: int, micro_batch: int, block: int) -> int:
    """Micro batches a step; the step must be a multiple of them."""
    if tokens_per_step % (micro_batch * block):
        raise ValueError(f"{tokens_per_step} tokens a step aren't a multiple of {micro_batch * block}")
    return tokens_per_step // (micro_batch * block)


def read_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, step, train_loss, val_loss, bpb): the points of a training log and, as kind "final", its last end line's.

    Points are in the order of their steps, the final row last; a log without points is an error. ``lines`` may carry ``n``, the line
    number, by which the last end line is chosen. A log is small: one task orders it.
    """
    c = F.col(line)
    end = F.contains(c, F.lit("epoch end"))
    value = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    points = lines.where(c.rlike(LOG_LINE) & ~end).select(
        F.lit("point").alias("kind"),
        value(LOG_LINE, 1).cast("int").alias("step"),
        *(value(LOG_LINE, i).cast("double").alias(n) for i, n in ((2, "train_loss"), (3, "val_loss"), (4, "bpb"))),
    )
    finals = lines.where(c.rlike(LOG_END) & (end | ~c.rlike(LOG_LINE)))
    if "n" in lines.columns:
        finals = finals.orderBy(F.desc("n")).limit(1)
    last = finals.select(
        F.lit("final").alias("kind"),
        value(LOG_END, 1).cast("int").alias("step"),
        F.lit(None).cast("double").alias("train_loss"),
        value(LOG_END, 2).cast("double").alias("val_loss"),
        value(LOG_END, 3).cast("double").alias("bpb"),
    )
    if points.isEmpty():
        raise ValueError("the log has no points")
    return points.unionByName(last).coalesce(1).sortWithinPartitions(F.desc("kind"), "step")


def top_k(rows: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """The rows of the ``k`` highest scores in each group, with all ties of the last."""
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    return rows.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def top_k_of(values: Column, k: int) -> Column:
    """Of an array of scores, (index, score) of the ``k`` highest, with all ties of the last."""
    least = F.get(F.sort_array(values, asc=False), F.least(F.lit(k), F.size(values)) - 1)
    pairs = F.transform(values, lambda v, i: F.struct(i.alias("index"), v.alias("score")))
    return F.filter(pairs, lambda p: p.score >= least)
