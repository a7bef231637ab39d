"""The pN_ queries: each problem's operator over its whole tables with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from . import encoding, langid, leakage, mixing, overlap, packing, pairs, quality, splitting, tokens


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = overlap.split_overlaps(table(spark, root, "corpus_records"), [])
    return pairs.select(F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b")).where("id_a < id_b").distinct()


def p1_links(spark: SparkSession, root: str) -> DataFrame:
    """Each evaluation record with a partner: its class, and how many train records have its text or one near it."""
    return overlap.overlap_links(table(spark, root, "corpus_records"), ["split"]).withColumnsRenamed({"id_eval": "id", "split_eval": "split"})


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Pairs and evaluation records concerned, per split and the sources of both sides."""
    records = table(spark, root, "corpus_records").withColumn("source", mixing.source_name(F.col("source"), F.col("id")))
    return overlap.overlap_report(records, ["split", "source"], ["source"]).withColumnRenamed("split_eval", "split")


def _in_prose_domain():
    return F.coalesce(F.substring_index("id", "/", 1).isin(*quality.PROSE_DOMAINS), F.lit(False))


def _statistics(spark: SparkSession, root: str, prose_only: bool) -> DataFrame:
    """The statistics of all records, or of those in the prose domains."""
    records = table(spark, root, "corpus_records").where("text is not null")
    records = records.withColumn("source", mixing.source_name(F.col("source"), F.col("id")))
    model = langid.fit_language_model(table(spark, root, "documents").where(F.col("domain").isin(*quality.PROSE_DOMAINS)))
    prose = records.where(_in_prose_domain())
    common = quality.common_words(prose, model, "text")
    hashed = (prose if prose_only else records).withColumn("text_hash", F.md5("text"))
    return materialise(quality.text_statistics(hashed, ["id", "source", "text_hash"], common, model), "p2-stats")


def _judged_prose(stats: DataFrame) -> DataFrame:
    prose = stats.where(_in_prose_domain())
    return quality.judged(prose.drop("text_hash"), quality.prose_model(prose, "text_hash"))


def p2_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Every text with its statistics; verdict, distance and contributions in the prose domains."""
    stats = _statistics(spark, root, False)
    return _judged_prose(stats).unionByName(stats.where(~_in_prose_domain()).drop("text_hash"), allowMissingColumns=True)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _judged_prose(_statistics(spark, root, True)).where("verdict = 'junk'").select("id").distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Texts and mean statistics per source and verdict."""
    means = [F.avg(c).alias(c) for c in ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share")]
    return p2_statistics(spark, root).groupBy("source", "verdict").agg(F.count("*").alias("n_texts"), *means)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    model = langid.fit_language_model(table(spark, root, "documents"))
    return pairs.broken_pairs(table(spark, root, "sft_toy"), model)


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Defective messages and the conversations with any, per defect."""
    return p3_found(spark, root).groupBy("defect").agg(F.count("*").alias("n_messages"), F.countDistinct("conv_id").alias("n_conversations"))


def p4_tokens(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_counts(table(spark, root, "documents"), table(spark, root, "tok_merges"), ["doc_id", "source", "lang", "domain"])


def p4_totals(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_totals(p4_tokens(spark, root), ["source", "lang", "domain"])


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of the oversized messages, redelivered conversations once."""
    long = splitting.messages(table(spark, root, "sft_toy")).where(F.octet_length("content") > splitting.LIMIT_BYTES).distinct()
    return splitting.split_texts(long, ["conv_id", "msg_idx", "role"], "content")


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root)


def p5_rejoined(spark: SparkSession, root: str) -> DataFrame:
    """What the pieces of each message say of it: its text again, and how many pieces are too long, empty or overlap too much or with another text."""
    rows = _pieces(spark, root).withColumn("raw", F.encode("piece", "UTF-8"))
    own = F.decode(F.expr("substring(raw, cast(new_from - start + 1 as int))"), "UTF-8")
    each = rows.select("conv_id", "msg_idx", "piece_no", own.alias("own"), F.octet_length("piece").alias("size"), (F.col("new_from") - F.col("start")).alias("overlap"), F.expr("substring(raw, 1, cast(new_from - start as int))").alias("head"), "piece")
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "own", "head", "piece")))
    whole = each.groupBy("conv_id", "msg_idx").agg(
        parts.alias("parts"), F.count_if(F.col("size") > 2000).alias("n_long"), F.count_if((F.length("own") == 0) | (F.col("overlap") > 200) | (F.col("overlap") < 0) | ((F.col("piece_no") > 0) & (F.col("overlap") == 0))).alias("n_odd")
    )
    text = F.array_join(F.transform("parts", lambda p: p.own), "")
    unlike = F.exists(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: ~F.endswith(F.encode(F.get("parts", i - 1).piece, "UTF-8"), F.get("parts", i).head))
    return whole.select("conv_id", "msg_idx", F.md5(text).alias("text_md5"), "n_long", "n_odd", unlike.alias("unlike"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).where("n_pieces > 1").select("conv_id", "msg_idx").distinct()


def _train_records(spark: SparkSession, root: str) -> DataFrame:
    """(id, source, n_bytes) of the train records, redelivered rows once."""
    records = table(spark, root, "corpus_records").where("split = 'train' and text is not null")
    return (
        records.select("id", mixing.source_name(F.col("source"), F.col("id")).alias("source"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("h"))
        .groupBy("id", "h")
        .agg(F.min("source").alias("source"), F.min("n_bytes").alias("n_bytes"))
        .drop("h")
    )


def p6_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_to_targets(_train_records(spark, root), table(spark, root, "mix_targets")).select("id", "source", "n_bytes", "copy_no")


def p6_shares(spark: SparkSession, root: str) -> DataFrame:
    records, targets = _train_records(spark, root), table(spark, root, "mix_targets")
    return mixing.mixture_report(mixing.mix_to_targets(records, targets), records, targets)


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    counted = tokens.token_counts(docs, table(spark, root, "tok_merges"), ["doc_id"])
    n = docs.where("text is not null").count()
    return packing.pack_items(counted, "doc_id", "n_tokens", expected=n).withColumnRenamed("item", "doc_id")


def p7_assigned(spark: SparkSession, root: str) -> DataFrame:
    """Each text's tokens and parts as its containers hold them, and how many of its containers hold too much."""
    packed = p7_containers(spark, root)
    over = packed.groupBy("grp", "container").agg(F.sum("size").alias("load")).where(F.col("load") > packing.CAPACITY).select("grp", "container", F.lit(1).alias("over"))
    return packed.join(over, ["grp", "container"], "left").groupBy("doc_id").agg(F.sum("size").alias("n_tokens"), F.count("*").alias("n_parts"), F.count("over").alias("n_over"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, root))


def p8_passages(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "test_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_passages(spark, root).select("doc_id", "item_id").distinct()


def p9_repairs(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return encoding.garbled(docs, encoding.cost_model(docs))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_repairs(spark, root).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_links, p1_report, p2_found, p2_report, p2_statistics, p3_found, p3_report, p4_tokens, p4_totals, p5_found, p5_pieces, p5_rejoined, p6_mixture, p6_shares, p7_assigned, p7_containers, p7_fill, p8_found, p8_passages, p9_found, p9_repairs)
}
