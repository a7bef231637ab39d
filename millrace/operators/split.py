"""Validation splits, reservoirs, samples and seeded orders.

Random choices depend only on counts and lengths, never on texts, so exact draws are made on the driver
for one domain at a time where its generator must be reproduced, and joined by index.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Documents that sampled segments touch to be sent to every task; more are joined by shuffle.
MAX_HITS = 100_000
#: Arrivals up to which the exact draws of a reservoir are made; more take ``hashed_val_split``.
MAX_DRAWS = 200_000_000
#: Fixed values of the corpus format.
SEED, VAL_FRACTION, VAL_MIN, VAL_MAX = 20260818, 0.005, 200, 20_000


def val_size(n: Column, reservoir: Column | None = None) -> Column:
    """Documents to hold out of ``n``: 0.5 percent, rounded half to even, within limits, never all."""
    k = F.greatest(F.lit(VAL_MIN), F.least(F.lit(VAL_MAX), F.rint(n * VAL_FRACTION)))
    held = F.least(n, F.lit(VAL_MAX)) if reservoir is None else reservoir
    return F.least(k, held, F.greatest(F.lit(0), n - 1)).cast("bigint")


def hashed_val_split(rows: DataFrame, key: str = "id", seed: str = "val") -> DataFrame:
    """``rows`` with ``split``: in each domain the ``val_size`` rows of the smallest seeded hash are val.

    The threshold comes from an exact selection: ranks are taken only among the rows below a hash bound that holds
    enough of them for sure, which is a bounded part of a domain.
    """
    sizes = rows.groupBy("domain").agg(F.count("*").alias("__n")).withColumn("__k", val_size(F.col("__n")))
    hashed = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256))
    unit = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 4294967296.0
    # twice the share and some more; a domain whose draw is still too short falls back to all its rows
    bound = F.least(F.lit(1.0), (F.col("__k") * 2 + 60) / F.col("__n"))
    few = hashed.join(F.broadcast(sizes), "domain").where(unit < bound)
    short = few.groupBy("domain").agg(F.count("*").alias("__c"), F.first("__k").alias("__k")).where("__c < __k").select("domain").collect()
    if short:
        few = hashed.join(F.broadcast(sizes), "domain").where((unit < bound) | F.col("domain").isin([r[0] for r in short]))
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy("domain").orderBy("__h", key))).where("__r <= __k")
    # an id may be in several domains
    val = ranked.select(F.col("domain").alias("__d"), F.col(key).alias("__key")).distinct()
    same = F.col("domain").eqNullSafe(F.col("__d")) & (F.col(key) == F.col("__key"))
    return rows.join(val.withColumn("__val", F.lit(True)), same, "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__d", "__key", "__val")


def reservoir_hits(n: int, capacity: int, seed: int) -> Iterator[tuple[int, int]]:
    """(arrival, slot) of the arrivals after the first ``capacity`` that replace a resident: Algorithm R with its generator.

    About ``capacity * ln(n / capacity)`` of them; the draws of the others aren't kept.
    """
    rng = random.Random(seed)
    for t in range(capacity, n):
        j = rng.randrange(t + 1)
        if j < capacity:
            yield t, j


def reservoir(rows: DataFrame, domain: str, n: int, capacity: int = VAL_MAX) -> DataFrame:
    """``rows`` of one domain (with 0-based arrival ``t``) with slot, resident and write_order.

    ``resident`` rows end up in the reservoir. ``write_order`` is the order in which rows go to train: a loser at its own
    time, an evicted row when it is evicted; residents have none. Only the draws after the first
    ``capacity`` are joined, of which few hit a slot; the table of hits is as long as the number of replacements.
    """
    if n > MAX_DRAWS:
        raise ValueError(f"{n} arrivals need {n} draws in a row; use hashed_val_split beyond {MAX_DRAWS}")
    spark = rows.sparkSession
    hits = list(reservoir_hits(n, capacity, SEED + zlib.crc32(domain.encode())))
    drawn = spark.createDataFrame(hits, "__t long, __s int") if hits else spark.createDataFrame([], "__t long, __s int")
    joined = rows.join(drawn, F.col("t") == F.col("__t"), "left")
    slot = F.when(F.col("t") < capacity, F.col("t")).otherwise(F.coalesce("__s", F.lit(-1))).cast("bigint")
    with_slot = joined.withColumn("slot", slot).drop("__t", "__s")
    entered = with_slot.where("slot >= 0").select(F.col("t").alias("__a"), F.col("slot").alias("__sl"))
    after = Window.partitionBy("__sl").orderBy("__a")
    evicted = entered.withColumn("__out", F.lead("__a").over(after)).select("__a", "__out")
    out = with_slot.join(evicted, F.col("t") == F.col("__a"), "left").drop("__a")
    order = F.when(F.col("slot") < 0, F.col("t")).otherwise(F.col("__out"))
    return out.withColumns({"resident": (F.col("slot") >= 0) & F.col("__out").isNull(), "write_order": order}).drop("__out")


def val_slots(domain: str, n: int, held: int) -> list[int]:
    """The reservoir slots drawn for validation."""
    k = min(max(VAL_MIN, min(VAL_MAX, int(round(VAL_FRACTION * n)))), held, max(0, n - 1))
    return sorted(random.Random(SEED + zlib.crc32(f"{domain}:val".encode())).sample(range(held), k)) if k else []


def val_pick(placed: DataFrame, domain: str, n: int, capacity: int = VAL_MAX) -> DataFrame:
    """``reservoir``'s rows of a domain with split and split_order: residents drawn for validation, in the order of their slots, all others train.

    To train go first the rows written while the reservoir was filled, in the order of their writing, then the residents left over, by slot.
    """
    drawn = val_slots(domain, n, min(n, capacity))
    slots = F.broadcast(placed.sparkSession.createDataFrame([(i, s) for i, s in enumerate(drawn)], "__i long, __s long"))  # VAL_MAX at most
    out = placed.join(slots, F.col("resident") & (F.col("slot") == F.col("__s")), "left")
    place = F.when(F.col("__i").isNotNull(), F.col("__i")).when(F.col("resident"), F.lit(n).cast("bigint") + F.col("slot")).otherwise(F.col("write_order"))
    return out.withColumns({"split": F.when(F.col("__i").isNotNull(), "val").otherwise("train"), "split_order": place}).drop("__i", "__s")


def smoke_val(subset: DataFrame, key: str = "id") -> DataFrame:
    """``smoke_subset``'s rows with split: of each domain's n rows max(1, min(n, max(round(0.005 n), 20))) of the smallest seeded hash are val, never all of several."""
    n = F.col("__n")
    k = F.greatest(F.lit(1), F.least(n, F.greatest(F.rint(n * VAL_FRACTION), F.lit(20)))).cast("bigint")
    sizes = subset.groupBy("domain").agg(F.count("*").alias("__n")).withColumn("__k", F.least(k, F.greatest(F.lit(1), n - 1)))
    hashed = subset.join(F.broadcast(sizes), "domain").withColumn("__h", F.sha2(F.concat(F.lit("smoke val:"), F.col(key)), 256))
    # a subset is a small mirror of fixed size
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("__h", key))
    return hashed.withColumn("split", F.when(rank <= F.col("__k"), "val").otherwise("train")).drop("__h", "__n", "__k")


def smoke_subset(lines: DataFrame, domains: DataFrame, divisor: int = 500, key: str = "id") -> DataFrame:
    """A small mirror of a corpus: of each domain the lines a seeded coin of probability ``min(1, 1.15 target / actual)`` keeps, until the byte target.

    ``lines``: domain, pos, line_bytes, ``key``; ``domains``: domain, target_bytes. The coin is a hash of the key, so the
    subset doesn't depend on partitioning. A domain whose coin keeps nothing gives its first lines, at most 50.
    """
    from .running import running_sums

    actual = lines.groupBy("domain").agg(F.sum("line_bytes").alias("__actual"))
    goals = actual.join(domains.select("domain", (F.col("target_bytes") / divisor).alias("__goal")), "domain")
    coin = F.conv(F.substring(F.sha2(F.concat(F.lit("smoke:"), F.col(key)), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    p = F.least(F.lit(1.0), F.col("__goal") / F.greatest(F.lit(1), F.col("__actual")) * 1.15)
    tossed = lines.join(F.broadcast(goals), "domain").withColumn("__heads", coin < p)
    picked = running_sums(tossed.where("__heads"), ["domain"], ["pos"], {"__before": F.col("line_bytes")}).where("__before < __goal")
    none = tossed.join(picked.select("domain").distinct(), "domain", "left_anti")
    first = running_sums(none, ["domain"], ["pos"], {"__before": F.col("line_bytes"), "__k": F.lit(1)}).where("__before < __goal and __k < 50")
    return picked.select(lines.columns).unionByName(first.select(lines.columns))


def segment_starts(length: int, n_chars: int, n_segments: int, seed: int) -> list[int]:
    """Sorted starts of equal segments drawn from a text of ``length`` characters; empty if the text is taken whole."""
    if n_chars <= 0 or n_segments <= 0:
        raise ValueError("n_chars and n_segments must be positive")
    if n_chars // n_segments < 1:
        raise ValueError("n_chars is too small for n_segments")
    if length <= n_chars:
        return []
    rng = random.Random(seed)
    span = n_chars // n_segments
    return sorted(rng.randrange(0, length - span) for _ in range(n_segments))


def segment_budget(n_chars: int, weight: float, n_segments: int) -> tuple[int, int]:
    """(characters, segments) of a domain in the tokenizer's training text."""
    budget = int(n_chars * weight)
    segments = max(1, round(n_segments * weight))
    return budget, (budget if budget and budget // segments < 1 else segments)


def segment_sample(docs: DataFrame, n_chars: int, n_segments: int, seed: int, order: str = "pos", text: str = "text") -> DataFrame:
    """(segment, piece, part): pieces of documents that make up the sampled segments, in order of (segment, piece).

    The documents joined by newlines are one long text; each segment is matched by range to the documents
    it touches. Only positions and lengths are ranged and summed; the few documents hit are joined to that, and cut where they lie.
    """
    rows = docs.select(F.lit("").alias("domain"), F.col(order).alias("pos"), F.col(text).alias("text"))
    return _segments(rows, None, {"": (n_chars, n_segments)}, seed).select("segment", "piece", "part")


def _segments(docs: DataFrame, pool: DataFrame | None, plan: dict[str, tuple[int, int]], seed: int) -> DataFrame:
    """(domain, segment, piece, part) of (domain, pos, text), with (characters, segments) for each domain; ``pool`` (domain, pos, size) has the documents that count, if not all do."""
    from .running import running_sums

    texts = docs.where(F.col("text").isNotNull())
    sized = texts.select("domain", "pos", F.length("text").alias("size")) if pool is None else pool
    placed = running_sums(sized.select("domain", F.col("pos").alias("piece"), (F.col("size") + 1).alias("__len")), ["domain"], ["piece"], {"__at": F.col("__len")})
    totals = {r[0]: r[1] - 1 for r in placed.groupBy("domain").agg(F.sum("__len")).collect()}
    drawn = []
    for domain, (n_chars, n_segments) in plan.items():
        starts = segment_starts(totals.get(domain, 0), n_chars, n_segments, seed)
        span = n_chars // n_segments if starts else totals.get(domain, 0)
        drawn += [(domain, i, s, span) for i, s in enumerate(starts or [0])]
    segments = F.broadcast(docs.sparkSession.createDataFrame(drawn, "__d string, segment int, __from long, __span long"))
    end = F.col("__from") + F.col("__span")
    lo, hi = F.greatest(F.col("__from"), F.col("__at")), F.least(end, F.col("__at") + F.col("__len"))
    hit = placed.join(segments, (F.col("domain") == F.col("__d")) & (F.col("__at") < end) & (F.col("__at") + F.col("__len") > F.col("__from")))
    hit = materialise(hit.select(F.col("domain").alias("__d"), "segment", "piece", (lo - F.col("__at") + 1).cast("int").alias("__lo"), (hi - lo).cast("int").alias("__n")), "segments")
    few = F.broadcast(hit) if hit.count() <= MAX_HITS else hit
    whole = F.concat(F.col("text"), F.lit("\n"))
    found = texts.join(few, (F.col("domain") == F.col("__d")) & (F.col("pos") == F.col("piece")))
    return found.select("domain", "segment", "piece", F.substr(whole, F.col("__lo"), F.col("__n")).alias("part"))


def training_text(docs: DataFrame, weights: dict[str, float], n_chars: int, n_segments: int, seed: int, oversample: int = 10) -> DataFrame:
    """(domain, segment, piece, part): the tokenizer's training text, a segment sample of each domain's first documents.

    ``docs``: domain, pos, text. A domain's pool are its documents until they have ``oversample`` times its share of the characters;
    in order of (domain, segment, piece) and with newlines between domains the parts are the text. A domain that should
    have a share and has no documents is an error.
    """
    from .running import running_sums

    plan = {d: segment_budget(n_chars, w, n_segments) for d, w in sorted(weights.items())}
    plan = {d: p for d, p in plan.items() if p[0] >= 1}
    if not plan:
        raise ValueError("no domain has a share of the text")
    rows = docs.where(F.col("text").isNotNull() & F.col("domain").isin(list(plan))).select("domain", "pos", "text")
    limits = F.create_map(*(x for d, p in plan.items() for x in (F.lit(d), F.lit(p[0] * oversample))))
    sized = rows.select("domain", "pos", F.length("text").alias("size"))
    pool = materialise(running_sums(sized, ["domain"], ["pos"], {"__at": F.col("size")}).where(F.col("__at") < limits[F.col("domain")]).drop("__at"), "pool")
    if missing := set(plan) - {r[0] for r in pool.select("domain").distinct().collect()}:
        raise ValueError(f"no documents of {sorted(missing)} for the tokenizer")
    return _segments(rows, pool, plan, seed)


def seeded_order(rows: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``rows`` with their 0-based place in a permutation that the seed and the keys (unique) fix."""
    from .running import dense_rank

    hashed = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    return dense_rank(hashed, [], ["__h"], name).drop("__h")


def epoch_rows(rows: DataFrame, key: str, seed: int, epoch: int = 0, skip: int = 0) -> DataFrame:
    """The rows of an epoch after ``skip``, with their ``place``; seeds of epochs differ."""
    if epoch < 0 or skip < 0:
        raise ValueError("epoch and skip must not be negative")
    return seeded_order(rows, key, seed + epoch).where(F.col("place") >= skip)
