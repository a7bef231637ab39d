"""Corpus building: cleaning, exact deduplication, ids, budgets, status and manifest.

Every operator takes the stream position of a record as a column (``pos``, unique within a
domain), as all semantics are by stream order: the first copy wins, ids are dense, budgets stop.
Configuration tables (domain, share, bytes_per_token, min_doc_bytes) have a row per domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DROP_REASONS, json_line, record_id, strip, unix_lines
from ..session import materialise
from .running import running_sums
from .split import val_size

MIN_DOC_BYTES = 200
#: Domains a configuration table may have to be sent to every task.
MAX_DOMAINS = 10_000


def select_domains(df: DataFrame, known: list[str], only: list[str] | None) -> DataFrame:
    """The rows of the wanted domains; unknown names are an error."""
    if unknown := sorted(set(only or []) - set(known)):
        raise ValueError(f"unknown domains: {unknown}")
    return df.where(F.col("domain").isin(only)) if only else df


def small(config: DataFrame) -> DataFrame:
    """A configuration table marked for broadcast, if it is as small as it should be."""
    return F.broadcast(config) if config.limit(MAX_DOMAINS + 1).count() <= MAX_DOMAINS else config


def clean(df: DataFrame, min_bytes: Column, raw: str = "raw") -> DataFrame:
    """``df`` with ``text`` and ``reason`` in place of ``raw``; null raw values give no row.

    In this order: invalid UTF-8 is ``utf8``; line ends become LF and white space at both ends goes; a
    NUL anywhere is ``control_char``; fewer than ``min_bytes`` bytes (null: 200) is ``too_short``. ``text`` is null
    where there is a reason.
    """
    as_text = F.col(raw).cast("string")
    stripped = strip(unix_lines(as_text))
    least = F.coalesce(min_bytes, F.lit(MIN_DOC_BYTES))
    out = df.where(F.col(raw).isNotNull()).withColumns({"__ok": F.is_valid_utf8(as_text), "__text": stripped, "__least": least})
    reason = (
        F.when(~F.col("__ok"), "utf8")
        .when(F.contains(F.col("__text"), F.lit("\x00")), "control_char")
        .when(F.octet_length("__text") < F.col("__least"), "too_short")
    )
    out = out.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), F.col("__text")))
    return out.drop("__ok", "__text", "__least", raw)


def clean_records(raw: DataFrame, config: DataFrame) -> DataFrame:
    """``clean`` of a (raw, domain, ...) table with each domain's own minimum."""
    least = config.select(F.col("domain").alias("__d"), "min_doc_bytes")
    return clean(raw.join(small(least), F.col("domain") == F.col("__d"), "left").drop("__d"), F.col("min_doc_bytes")).drop("min_doc_bytes")


def first_copies(df: DataFrame, domain: str = "domain", text: str = "text", pos: str = "pos") -> DataFrame:
    """The first row of each text in its domain, by ``pos``; rows with a null text are left out.

    An aggregation, not a window: copies meet in the map-side part already, so a text that a third of all
    rows have is no hot key.
    """
    rest = [c for c in df.columns if c not in (domain, text, pos)]
    key = F.sha2(F.col(text), 256).alias("__sha")
    row = F.struct(F.col(pos), F.col(text), *rest).alias("__row")
    kept = df.where(F.col(text).isNotNull()).select(domain, key, row).groupBy(domain, "__sha").agg(F.min("__row").alias("__row"))
    return kept.select(*(F.col(domain) if c == domain else F.col("__row")[c].alias(c) for c in df.columns))


def duplicate_counts(df: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """(domain, n, n_distinct, n_duplicate) over non-null texts."""
    per_text = df.where(F.col(text).isNotNull()).groupBy(domain, F.sha2(F.col(text), 256).alias("__sha")).agg(F.count("*").alias("k"))
    return per_text.groupBy(domain).agg(
        F.sum("k").alias("n"), F.count("*").alias("n_distinct"), (F.sum("k") - F.count("*")).alias("n_duplicate")
    )


def new_texts(batch: DataFrame, kept: DataFrame, domain: str = "domain", text: str = "text", pos: str = "pos") -> DataFrame:
    """The first copies of ``batch`` whose text ``kept`` doesn't have in the domain: an incremental load."""
    seen = kept.where(F.col(text).isNotNull()).select(F.col(domain).alias("__d"), F.sha2(F.col(text), 256).alias("__h")).distinct()
    fresh = first_copies(batch, domain, text, pos)
    return fresh.join(seen, F.col(domain).eqNullSafe(F.col("__d")) & (F.sha2(F.col(text), 256) == F.col("__h")), "left_anti")


def numbered(kept: DataFrame) -> DataFrame:
    """``kept`` with ``id`` by stream order in its domain, ``line_bytes``, and ``n_before`` and ``bytes_before`` of the lines before.

    Texts are written once and joined to their numbers last, so what needs no text moves none.
    """
    # an id has a fixed length below 10^9, so the line's length doesn't depend on its number
    size = F.octet_length(json_line(F.col("text"), F.col("domain"), record_id(F.col("domain"), F.lit(0)))) + 1
    sized = materialise(kept.withColumn("line_bytes", size.cast("bigint")), "kept")
    places = running_sums(sized.select("domain", "pos", "line_bytes"), ["domain"], ["pos"], {"n_before": F.lit(1), "bytes_before": F.col("line_bytes")})
    places = places.select(F.col("domain").alias("__d"), F.col("pos").alias("__q"), "n_before", "bytes_before")
    out = sized.join(places, F.col("domain").eqNullSafe(F.col("__d")) & (F.col("pos") == F.col("__q"))).drop("__d", "__q")
    return out.withColumn("id", record_id(F.col("domain"), F.col("n_before")))


def target_bytes(tokens: int) -> Column:
    """Bytes a domain should have, from its share and bytes per token; rounded half to even."""
    return F.rint(F.lit(float(tokens)) * F.col("share") * F.col("bytes_per_token")).cast("bigint")


def within_budget(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """The lines up to the one that reaches the domain's target (domain, target_bytes); a domain without a target has none."""
    limits = targets.select(F.col("domain").alias("__d"), F.col("target_bytes").alias("__limit"))
    return lines.join(small(limits), F.col("domain") == F.col("__d")).where("bytes_before < __limit").drop("__d", "__limit")


def slot_targets(targets: DataFrame, slots: DataFrame) -> DataFrame:
    """(domain, slot, slot_target): slot i of n fills to ``min(target, int(target / n * (i + 1)))``."""
    count = slots.select("domain", "slot").distinct().groupBy("domain").agg(F.count("*").alias("__n"))
    each = slots.select("domain", "slot").distinct().join(count, "domain").join(targets.select("domain", "target_bytes"), "domain")
    fill = F.floor(F.col("target_bytes") / F.col("__n") * (F.col("slot") + 1)).cast("bigint")
    return each.select("domain", "slot", F.least("target_bytes", fill).alias("slot_target"))


def within_slots(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """The lines a domain takes when slots (0, 1, ...) are pulled in turn, each up to its own target.

    ``lines`` has domain, slot, pos, line_bytes, with positions of later slots after those of earlier ones.
    A slot that is short leaves the more to the next: what a slot adds is bounded by its target less
    what is there already, which is a fold over the few slots of a domain.
    """
    per_slot = slot_targets(targets, lines)
    ranked = running_sums(lines, ["domain", "slot"], ["pos"], {"__before": F.col("line_bytes")})
    n_slots = per_slot.agg(F.max("slot")).first()[0]
    state = per_slot.select("domain").distinct().withColumn("__kept", F.lit(0).cast("bigint"))
    parts = []
    for i in range((n_slots if n_slots is not None else -1) + 1):
        goal = per_slot.where(F.col("slot") == i).select("domain", "slot_target")
        room = state.join(goal, "domain").select(F.col("domain").alias("__d"), (F.col("slot_target") - F.col("__kept")).alias("__room"))
        taken = ranked.where(F.col("slot") == i).join(small(room), F.col("domain") == F.col("__d")).where("__before < __room").drop("__d", "__room")
        parts.append(taken)
        added = taken.groupBy("domain").agg(F.sum("line_bytes").alias("__add"))
        state = state.join(added, "domain", "left").select("domain", (F.col("__kept") + F.coalesce("__add", F.lit(0))).alias("__kept"))
    if not parts:
        return lines.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("__before")


def domain_status(kept: DataFrame, targets: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(domain, target_bytes, kept_bytes, status): complete, partial (under 95 % of the target) or blocked.

    ``kept`` has domain and line_bytes; ``blocked`` lists domains a source failed for: blocked if they have
    nothing, else partial.
    """
    have = kept.groupBy("domain").agg(F.sum("line_bytes").alias("__b"))
    out = targets.select("domain", "target_bytes").join(have, "domain", "left").withColumn("kept_bytes", F.coalesce("__b", F.lit(0)))
    if blocked is not None:
        out = out.join(blocked.select("domain").distinct().withColumn("__x", F.lit(True)), "domain", "left")
    else:
        out = out.withColumn("__x", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("__x") & (F.col("kept_bytes") == 0), "blocked")
        .when(F.col("__x") | (F.col("kept_bytes") < F.col("target_bytes") * 0.95), "partial")
        .otherwise("complete")
    )
    return out.select("domain", "target_bytes", "kept_bytes", status.alias("status"))


def drop_tally(cleaned: DataFrame, kept: DataFrame) -> DataFrame:
    """(domain, n_read, n_kept, then a count for every drop reason) of cleaned rows and those kept of them."""
    reasons = cleaned.groupBy("domain").agg(
        F.count("*").alias("n_read"), *(F.count_if(F.col("reason") == r).alias(r) for r in DROP_REASONS if r != "duplicate")
    )
    n = kept.groupBy("domain").agg(F.count("*").alias("n_kept"))
    out = reasons.join(n, "domain", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    good = F.col("n_read") - F.col("utf8") - F.col("control_char") - F.col("too_short")
    return out.select("domain", "n_read", "n_kept", "utf8", "too_short", (good - F.col("n_kept")).alias("duplicate"), "control_char")


def kept_sizes(cleaned: DataFrame) -> DataFrame:
    """(domain, n_read, n_kept, <drop reasons>, bytes) of cleaned rows: what is read, dropped and kept, with the bytes of the kept lines.

    Only hashes and sizes are shuffled: copies have one size, so neither the texts nor their numbers are needed.
    """
    size = F.octet_length(json_line(F.col("text"), F.col("domain"), record_id(F.col("domain"), F.lit(0)))) + 1
    texts = cleaned.groupBy("domain", "reason", F.unhex(F.sha2("text", 256)).alias("__h")).agg(F.count("*").alias("k"), F.min(size).alias("size"))
    good = F.col("reason").isNull()
    return texts.groupBy("domain").agg(
        F.sum("k").alias("n_read"), F.count_if(good).alias("n_kept"),
        *(F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("k"))), F.lit(0)).alias(r) for r in ("utf8", "too_short")),
        F.coalesce(F.sum(F.when(good, F.col("k") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(F.col("reason") == "control_char", F.col("k"))), F.lit(0)).alias("control_char"),
        F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).cast("bigint").alias("bytes"),
    )


def domain_results(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``kept_sizes`` with docs_train, docs_val and status for each domain of ``targets`` (domain, target_bytes)."""
    out = targets.select("domain", "target_bytes").join(sizes, "domain", "left")
    counts = [c for c in sizes.columns if c != "domain"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    out = out.withColumn("docs_val", val_size(F.col("n_kept"))).withColumn("docs_train", F.col("n_kept") - F.col("docs_val"))
    status = F.when(F.col("bytes") < F.col("target_bytes") * 0.95, "partial").otherwise("complete")
    return out.withColumn("status", status)


def build_report(results: list[dict]) -> str:
    """A text report of domain results: sizes, then dropped records, then shortfalls and blocked domains."""
    rows = sorted(results, key=lambda r: r["domain"])
    lines = [f"{'domain':<20}{'train':>10}{'val':>8}{'bytes':>16}{'target':>16}  status"]
    lines += [f"{r['domain']:<20}{r['docs_train']:>10}{r['docs_val']:>8}{r['bytes']:>16}{r['target_bytes']:>16}  {r['status']}" for r in rows]
    lines += ["", f"{'dropped':<20}" + "".join(f"{c:>14}" for c in DROP_REASONS)]
    lines += [f"{r['domain']:<20}" + "".join(f"{r[c]:>14}" for c in DROP_REASONS) for r in rows]
    short = [r for r in rows if r["status"] == "partial"]
    lines += [""] + [f"{r['domain']} is {r['target_bytes'] - r['bytes']} bytes short ({1 - r['bytes'] / max(1, r['target_bytes']):.1%})" for r in short]
    lines += [f"{r['domain']} is blocked" for r in rows if r["status"] == "blocked"]
    return "\n".join([*lines, f"total {sum(r['bytes'] for r in rows)} bytes"])


def manifest(lines: DataFrame, config: DataFrame) -> DataFrame:
    """(domain, documents, bytes, actual_share, estimated_tokens) and a row of totals with a null domain.

    ``lines`` has domain and line_bytes, or domain, n_kept and bytes of whole domains. The total's estimate is the sum of the domains'.
    """
    summed = "line_bytes" not in lines.columns
    per = lines.where("n_kept > 0").select("domain", F.col("n_kept").alias("documents"), "bytes") if summed else lines.groupBy("domain").agg(F.count("*").alias("documents"), F.sum("line_bytes").alias("bytes"))
    est = per.join(small(config.select("domain", "bytes_per_token")), "domain").select(
        "domain", "documents", "bytes", F.floor(F.col("bytes") / F.col("bytes_per_token")).cast("bigint").alias("estimated_tokens")
    )
    total = est.agg(*(F.sum(c).alias(c) for c in ("documents", "bytes", "estimated_tokens"))).withColumn("domain", F.lit(None).cast("string"))
    both = est.unionByName(total)
    whole = F.broadcast(total.select(F.col("bytes").alias("__all")))  # one row
    return both.crossJoin(whole).select(
        "domain", "documents", "bytes", F.coalesce(F.try_divide(F.col("bytes"), F.col("__all")), F.lit(0.0)).alias("actual_share"), "estimated_tokens"
    )


def disk_needed(targets: list[int]) -> int:
    """Bytes to have free before a build: the targets, five percent and two GiB."""
    return math.ceil(sum(targets) * 1.05) + 2 * 1024**3
