"""Named queries of the core operators over the test tables, and their SQL.

raw_records is the builder's input, corpus_records a finished corpus, documents a corpus by domain with doc_id as its stream
position, sft_toy the conversations.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, json_line
from ..operators import blocks, chat, corpus, metrics, mix, split, tokenizer, verify
from ..operators.running import dense_rank
from ..session import materialise, scratch, table
from ..sources import readers, shards, writers
from ..streaming import ingest
from . import sqltext

#: Parameters of the queries: tokens of the byte budget and of the mixture, blocks and shards, parts of the subset, rows of the reservoir.
BUDGET_TOKENS, MIX_TOKENS, BLOCK, SHARD, DIVISOR, RESERVOIR = 20_000, 100_000, 1024, 50_000, 5, 50
#: The system message of the agent windows.
SYSTEM = "Solve the task with the tools at hand and say what you did."
LOG = [
    "epoch 0 | step 200 | lr 0.001 | train loss = 4.20 | val loss = 4.10 | bpb = 1.51",
    "noise",
    "epoch 0 | step 100 | lr 0.001 | train loss = 5.25 | val loss = 5.50 | bpb = 2.01",
    "[epoch end] epoch 0 | step 300 | val loss = 3.75 | bpb = 1.40",
]


def _cleaned(spark: SparkSession, root: str) -> DataFrame:
    return corpus.clean_records(table(spark, root, "raw_records"), table(spark, root, "domain_config"))


def _kept(spark: SparkSession, root: str) -> DataFrame:
    return corpus.first_copies(_cleaned(spark, root).where("reason is null").drop("reason"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return corpus.numbered(_kept(spark, root))


def _targets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "domain_config").select("domain", corpus.target_bytes(BUDGET_TOKENS).alias("target_bytes"))


def _weights(spark: SparkSession, root: str) -> dict[str, float]:
    rows = table(spark, root, "domain_config").select("domain", "share").limit(corpus.MAX_DOMAINS + 1).collect()
    if len(rows) > corpus.MAX_DOMAINS:
        raise ValueError(f"more than {corpus.MAX_DOMAINS} domains")
    return {r["domain"]: r["share"] for r in rows}


def _sized(spark: SparkSession, root: str) -> DataFrame:
    """(domain, pos, n_tokens) of documents, a token counted as four bytes, so that SQL can follow."""
    docs = table(spark, root, "documents").where("text is not null")
    return docs.select("domain", F.col("doc_id").alias("pos"), F.expr("octet_length(text) div 4 + 1").alias("n_tokens"))


def clean_text(spark, root):
    return _cleaned(spark, root).select("domain", "slot", "pos", "text", "reason")


def clean_reasons(spark, root):
    return _cleaned(spark, root).groupBy("domain", "reason").agg(F.count("*").alias("n"))


def dedup_exact(spark, root):
    return _kept(spark, root).select("domain", "pos", "text")


def dedup_counts(spark, root):
    return corpus.duplicate_counts(_cleaned(spark, root).where("reason is null"))


def incremental_load(spark, root):
    rows = _cleaned(spark, root).where("reason is null").select("domain", "slot", "pos", "text")
    return corpus.new_texts(rows.where("pos % 3 = 0"), rows.where("pos % 3 <> 0")).select("domain", "pos")


def document_ids(spark, root):
    return _lines(spark, root).select("domain", "pos", "id", "line_bytes", "bytes_before")


def byte_budget(spark, root):
    return corpus.within_budget(_lines(spark, root), _targets(spark, root)).select("domain", "pos", "id")


def slot_budget(spark, root):
    lines = _lines(spark, root).select("domain", F.expr("cast(pos % 2 as int)").alias("slot"), "pos", "line_bytes")
    return corpus.within_slots(lines, _targets(spark, root)).select("domain", "slot", "pos")


def domain_status(spark, root):
    kept = corpus.within_budget(_lines(spark, root), _targets(spark, root))
    return corpus.domain_status(kept, _targets(spark, root))


def domain_result(spark, root):
    return corpus.kept_sizes(_cleaned(spark, root))


def domain_outcome(spark, root):
    """Documents to train and val, bytes, drops and status of each configured domain."""
    return corpus.domain_results(corpus.kept_sizes(_cleaned(spark, root)), _targets(spark, root))


def manifest(spark, root):
    return corpus.manifest(corpus.kept_sizes(_cleaned(spark, root)), table(spark, root, "domain_config"))


def val_sizes(spark, root):
    per = table(spark, root, "corpus_records").groupBy(F.substring_index("id", "/", 1).alias("domain")).agg(F.count("*").alias("n"))
    return per.withColumn("k", split.val_size(F.col("n")))


def val_split(spark, root):
    rows = table(spark, root, "documents").select("domain", F.col("doc_id").cast("string").alias("id"))
    return split.hashed_val_split(rows).groupBy("domain", "split").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def reservoir(spark, root):
    """Every row's slot, stay and writing order with a reservoir for each domain; draws depend on counts only."""
    rows = dense_rank(table(spark, root, "documents").select("domain", "doc_id"), ["domain"], ["doc_id"], "t")
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    out = None
    for domain, n in sorted(sizes.items()):
        part = split.reservoir(rows.where(F.col("domain") == domain), domain, n, RESERVOIR)
        out = part if out is None else out.unionByName(part)
    return out.select("domain", "t", "slot", "resident", "write_order")


def val_pick(spark, root):
    """Rows of each domain as validation and training data, in their order."""
    rows = dense_rank(table(spark, root, "documents").select("domain", "doc_id"), ["domain"], ["doc_id"], "t")
    out = None
    for domain, n in sorted((r[0], r[1]) for r in rows.groupBy("domain").count().collect()):
        placed = split.reservoir(rows.where(F.col("domain") == domain), domain, n, RESERVOIR)
        part = split.val_pick(placed, domain, n, RESERVOIR)
        out = part if out is None else out.unionByName(part)
    return out.select("domain", "doc_id", "split", "split_order")


def smoke_val(spark, root):
    return split.smoke_val(smoke_subset(spark, root)).select("domain", "pos", "split")


def smoke_subset(spark, root):
    lines = _lines(spark, root)
    goals = lines.groupBy("domain").agg(F.sum("line_bytes").alias("target_bytes"))
    return split.smoke_subset(lines.select("domain", "pos", "id", "line_bytes"), goals, DIVISOR).select("domain", "pos", "id")


def segment_sample(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("pos"), "text")
    parts = split.segment_sample(docs, 20_000, 40, 0)
    return parts.groupBy("segment").agg(F.sum(F.length("part")).alias("n_chars"), F.count("*").alias("n_pieces"))


def tokenizer_text(spark, root):
    docs = table(spark, root, "documents").select("domain", F.col("doc_id").alias("pos"), "text")
    parts = split.training_text(docs, _weights(spark, root), 40_000, 100, 0)
    return parts.groupBy("domain").agg(F.sum(F.length("part")).alias("n_chars"), F.countDistinct("segment").alias("n_segments"))


def epoch_order(spark, root):
    return split.epoch_rows(table(spark, root, "documents").select("doc_id"), "doc_id", 1234, 1, 10)


def mix_order(spark, root):
    got = mix.mix_order(_sized(spark, root), _weights(spark, root), MIX_TOKENS)
    return got.select(F.col("pos").alias("doc_id"), "domain", "place", "tokens_before")


def mix_stats(spark, root):
    weights = _weights(spark, root)
    return mix.mix_stats(mix.mix_order(_sized(spark, root), weights, MIX_TOKENS), weights)


def mix_exhausted(spark, root):
    total = _sized(spark, root).agg(F.sum("n_tokens")).first()[0] or 0
    return mix.exhausted(_sized(spark, root), _weights(spark, root), total * 3 // 4)


def stream_layout(spark, root):
    placed = blocks.stream_offsets(_sized(spark, root).select("pos", "n_tokens"), ["pos"])
    unit = lambda n, c: F.floor(F.col(c) / n).cast("bigint")
    return placed.withColumn("last", F.col("offset") + F.col("n_tokens") - 1).select(
        F.col("pos").alias("doc_id"), "offset", unit(SHARD, "offset").alias("first_shard"), unit(SHARD, "last").alias("last_shard"),
        unit(BLOCK, "offset").alias("first_block"), unit(BLOCK, "last").alias("last_block"),
    )


def batch_layout(spark, root):
    rows = dense_rank(table(spark, root, "documents").select("doc_id"), [], ["doc_id"], "place")
    return blocks.batches(rows, "place", 16, True)


def _encoded(spark: SparkSession, root: str) -> DataFrame:
    tok = tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))
    return materialise(tokenizer.encode(table(spark, root, "documents"), tok, ["doc_id"], bos=True), "ids")


def presplit(spark, root):
    docs = tokenizer.presplit(table(spark, root, "documents").where("text is not null"))
    return docs.select("doc_id", F.size("pieces").alias("n_pieces"), F.md5(F.array_join("pieces", "\x1f")).alias("pieces_md5"))


def word_frequencies(spark, root):
    return tokenizer.word_frequencies(table(spark, root, "documents"), "doc_id").select("word", "n")


def pair_counts(spark, root):
    return tokenizer.pair_counts(tokenizer.word_frequencies(table(spark, root, "documents"), "doc_id"))


def bpe_training(spark, root):
    """The merges learned from a sample of fixed size."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("pos"), "text")
    parts = materialise(split.segment_sample(docs, 200_000, 50, 0), "sample").withColumn("at", F.col("segment") * F.lit(1 << 40).cast("bigint") + F.col("piece"))
    tok = tokenizer.train_on(parts, "at", 256 + len(tokenizer.SPECIAL_TOKENS) + 200, "part")
    rows = [(k, a, b, tok.vocab[256 + k]) for k, (a, b) in enumerate(tok.merges)]
    return spark.createDataFrame(rows, "merge_no int, left_id int, right_id int, piece binary")


def _joined(ids) -> Column:
    """What stands for an array of numbers where results are compared."""
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","))


def token_ids(spark, root):
    """The tokens of each document, bos first."""
    return _encoded(spark, root).select("doc_id", F.size("ids").alias("n_tokens"), _joined("ids").alias("ids_md5"))


def token_bytes(spark, root):
    """The bytes of each token, special ones 0, and how often documents use it."""
    tok = tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))
    used = _encoded(spark, root).select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    sizes = spark.createDataFrame(list(enumerate(tok.token_bytes())), "token_id int, n_bytes int")
    return sizes.join(used, "token_id", "left").select("token_id", "n_bytes", F.coalesce("n", F.lit(0)).alias("n"))


def token_round_trip(spark, root):
    tok = tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))
    plain = _encoded(spark, root).withColumn("ids", F.expr("slice(ids, 2, size(ids))"))
    return tokenizer.decode(plain, tok, ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


def _placed(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    ids = _encoded(spark, root)
    total = ids.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    # only sizes are ranged and summed, the tokens are joined to their offsets
    return ids.join(blocks.stream_offsets(ids.select("doc_id", F.size("ids").alias("n_tokens")), ["doc_id"]).drop("n_tokens"), "doc_id"), total


def token_windows(spark, root):
    placed, total = _placed(spark, root)
    return blocks.windows(placed, BLOCK, total).select("block", _joined("input_ids").alias("inputs_md5"), _joined("labels").alias("labels_md5"))


def last_window(spark, root):
    """The last window, fetched alone."""
    placed, total = _placed(spark, root)
    return blocks.window_at(placed, BLOCK, total, -1).select("block", _joined("input_ids").alias("inputs_md5"), _joined("labels").alias("labels_md5"))


def special_tokens(spark, root):
    tok = _tokenizer(spark, root)
    return spark.createDataFrame(sorted(tok.special.items()), "name string, token_id int")


def token_shards(spark, root):
    """Shards written to files and read again."""
    shards.register(spark)
    placed, _ = _placed(spark, root)
    path = scratch(spark, "shards")
    blocks.shards(placed, SHARD).select("shard", "tokens").write.format("token_shards").mode("append").option("path", path).option("prefix", "train").save()
    read = spark.read.format("token_shards").option("path", path).option("prefix", "train").load()
    return read.select("shard", "offset", F.size("tokens").alias("n_tokens"), _joined("tokens").alias("tokens_md5"))


def agent_windows(spark, root):
    got = chat.agent_windows(table(spark, root, "sft_toy").dropDuplicates(["conv_id"]), ["conv_id"], SYSTEM)
    text = F.transform("sample", lambda m: F.concat_ws(":", m.role, F.coalesce(m.content, F.lit("-"))))
    return got.select("conv_id", "turn", F.size("sample").alias("n_messages"), F.md5(F.array_join(text, "|")).alias("content_md5"))


def _rendered(spark: SparkSession, root: str) -> DataFrame:
    tok = tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))
    samples = chat.agent_windows(table(spark, root, "sft_toy").dropDuplicates(["conv_id"]), ["conv_id"], SYSTEM)
    return chat.rendered(samples, tok, ["conv_id", "turn"], BLOCK, "sample")


def rendered_items(spark, root):
    inputs, labels = chat.training_item(F.col("ids"), F.col("mask"))
    return _rendered(spark, root).where("error is null").select("conv_id", "turn", F.size("ids").alias("n_tokens"), _joined(inputs).alias("inputs_md5"), _joined(labels).alias("labels_md5"))


def padded_batches(spark, root):
    """The rendered items of each eight conversations, filled to the longest of their batch."""
    inputs, labels = chat.training_item(F.col("ids"), F.col("mask"))
    items = _rendered(spark, root).where("error is null").select("conv_id", "turn", F.expr("cast(conv_id div 8 as bigint)").alias("batch"), inputs.alias("input_ids"), labels.alias("labels"))
    return chat.padded(items).select("conv_id", "turn", F.size("input_ids").alias("n"), _joined("input_ids").alias("inputs_md5"), _joined("labels").alias("labels_md5"))


def supervision(spark, root):
    return chat.supervision(_rendered(spark, root).where("error is null"), 500, ["conv_id", "turn"])


def plain_conversations(spark, root):
    got = chat.plain_conversations(table(spark, root, "sft_toy").dropDuplicates(["conv_id"]), ["conv_id"])
    return got.select("conv_id", "shape", F.size("sample").alias("n_messages"))


def fitting_conversations(spark, root):
    tok = tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))
    got = chat.fitting(chat.plain_conversations(table(spark, root, "sft_toy").dropDuplicates(["conv_id"]), ["conv_id"]), tok, ["conv_id"], BLOCK)
    return got.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"))


def _tokenizer(spark: SparkSession, root: str) -> tokenizer.Tokenizer:
    return tokenizer.Tokenizer.from_table(table(spark, root, "tok_merges"))


def prompt_tokens(spark, root):
    """The tokens before the answer of each agent window's task and history."""
    samples = chat.agent_windows(table(spark, root, "sft_toy").dropDuplicates(["conv_id"]), ["conv_id"], SYSTEM)
    before = samples.select("conv_id", "turn", F.slice("sample", F.lit(1), F.size("sample") - 1).alias("sample"))
    got = chat.prompts(before, _tokenizer(spark, root), ["conv_id", "turn"], BLOCK, "sample")
    return got.select("conv_id", "turn", F.size("ids").alias("n_tokens"), _joined("ids").alias("ids_md5"))


def sft_samples(spark, root):
    """The first conversations that fit, a half of all at most, in shuffled order."""
    talks = table(spark, root, "sft_toy").dropDuplicates(["conv_id"])
    return chat.sft_samples(talks, _tokenizer(spark, root), "conv_id", BLOCK, max(1, talks.count() // 2), 7)[0].select("conv_id", "n_tokens", "place")


def sft_counts(spark, root):
    talks = table(spark, root, "sft_toy").dropDuplicates(["conv_id"])
    return chat.sft_samples(talks, _tokenizer(spark, root), "conv_id", BLOCK, max(1, talks.count() // 2), 7)[1]


def hold_out(spark, root):
    got = chat.hold_out(table(spark, root, "sft_toy").select("conv_id").distinct(), "conv_id")
    return got.groupBy("split").agg(F.count("*").alias("n"), F.max("conv_id").alias("last"))


def verify_records(spark, root):
    records = table(spark, root, "corpus_records").withColumn("domain", F.substring_index("file_name", "/", 1))
    return verify.check_records(records, table(spark, root, "domain_config"))


def verify_files(spark, root):
    """A corpus's files by domain and split, against a manifest in which one domain's bytes are wrong and one is blocked."""
    records = table(spark, root, "corpus_records").where("text is not null and id is not null")
    domain = F.substring_index("file_name", "/", 1)
    files = records.groupBy(domain.alias("domain"), F.concat("split", F.lit("_000.jsonl")).alias("name")).agg((F.sum(F.octet_length("text")) * 400).alias("bytes"))
    sizes = files.groupBy("domain").agg(F.sum("bytes").alias("bytes"))
    wrong = F.when(F.col("domain") == "web_edu", F.col("bytes") + 1).otherwise(F.col("bytes"))
    config = table(spark, root, "domain_config").select("domain").join(sizes, "domain", "left")
    return verify.check_files(files, config.select("domain", wrong.alias("bytes"), F.when(F.col("domain") == "code_shell", "blocked").otherwise("complete").alias("status")))


def verify_smoke(spark, root):
    """The small mirror against the corpus, of which it lacks a domain."""
    sizes = corpus.kept_sizes(_cleaned(spark, root)).select("domain", "bytes")
    return verify.check_smoke(sizes, sizes.where("domain <> 'web_edu'"))


def verify_shares(spark, root):
    sizes = corpus.kept_sizes(_cleaned(spark, root)).select("domain", "bytes")
    return verify.check_shares(sizes, table(spark, root, "domain_config"))


def _written(spark: SparkSession, root: str) -> str:
    path = scratch(spark, "corpus")
    lines = _lines(spark, root).select("text", F.col("domain").alias("source"), "id", "domain", F.lit("train").alias("split"), "pos")
    writers.write_corpus(lines, path, limit=100_000)
    return path


def written_corpus(spark, root):
    """Lines written in rotated files and read back: lines and bytes of each domain."""
    lines = spark.read.option("lineSep", "\n").text(_written(spark, root))
    return lines.groupBy(F.col("domain")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value") + 1).cast("bigint").alias("n_bytes"))


def verify_lines(spark, root):
    """Lines of records some of which have a key too many, lack one or aren't objects."""
    records = table(spark, root, "corpus_records").where("id is not null and text is not null and source is not null")
    line = json_line(F.col("text"), F.col("source"), F.col("id"))
    more = F.concat(F.lit('{"more":1,'), F.substr(line, F.lit(2)))
    less = F.to_json(F.struct("text", "id"))
    broken = F.when(F.endswith("id", F.lit("3")), more).when(F.endswith("id", F.lit("5")), less).when(F.endswith("id", F.lit("7")), F.lit("[1]")).otherwise(line)
    return verify.check_lines(records.select(broken.alias("value")))


def strict_records(spark, root):
    """Records written as JSON lines and read again strictly, line by line."""
    path = scratch(spark, "strict")
    records = table(spark, root, "corpus_records").where("id is not null and text <> '' and source is not null")
    line = json_line(F.col("text"), F.col("source"), F.col("id"))
    records.select(line.alias("value")).write.mode("overwrite").text(f"{path}/some")
    lines = readers.strict(readers.numbered_lines(spark, f"{path}/some"), F.concat("file", F.lit(":"), F.col("line").cast("string")))
    rest = F.from_json("value", "source string, id string")
    return lines.select(rest["id"].alias("id"), rest["source"].alias("source"), F.md5("text").alias("text_md5"))


def conversation_file(spark, root):
    """Conversations written as lines and read again."""
    path = scratch(spark, "talk")
    talks = table(spark, root, "sft_toy").where("size(messages) > 0").dropDuplicates(["conv_id"])
    writers.write_conversations(talks, f"{path}/some")
    said = F.transform("messages", lambda m: F.concat_ws(":", m.role, F.coalesce(m.content, F.lit("-"))))
    got = readers.read_conversations(spark, f"{path}/some")
    return got.select(F.size("messages").alias("n_messages"), F.md5(F.array_join(said, "|")).alias("content_md5"))


def parquet_rows(spark, root):
    """A parquet source as the builder reads it."""
    got = readers.open_source(spark, "parquet", f"{root}/documents.parquet", "text")
    return got.select(F.md5("raw").alias("raw_md5")).groupBy("raw_md5").agg(F.count("*").alias("n"))


def chosen_domains(spark, root):
    known = list(_weights(spark, root))
    return corpus.select_domains(_cleaned(spark, root), known, ["code_python", "web_edu"]).groupBy("domain").agg(F.count("*").alias("n"))


def corpus_bytes(spark, root):
    """Bytes of the files of a written corpus, and those to have free for its targets."""
    need = corpus.disk_needed([r[0] for r in _targets(spark, root).select("target_bytes").collect()])
    path = _written(spark, root)
    # without what the committer leaves beside the files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.agg(F.sum("length").alias("n_bytes")).withColumn("disk_needed", F.lit(need).cast("bigint"))


def credited_tokens(spark, root):
    """The tokens of each domain that has a weight."""
    weights = _weights(spark, root)
    own = _sized(spark, root).where(F.col("domain").isin(list(weights)))
    return mix.credited(own, weights).groupBy("domain").agg(F.sum("n_tokens").alias("n_tokens"))


def lenient_lines(spark, root):
    """Every fifth record's line broken, then read leniently."""
    records = table(spark, root, "corpus_records").where("id is not null")
    line = json_line(F.col("text"), F.col("source"), F.col("id"))
    broken = F.when(F.endswith("id", F.lit("5")), F.substr(line, F.lit(2))).otherwise(line)
    return readers.lenient(records.select(broken.alias("value"))).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("n_bytes"))


def learning_rates(spark, root):
    steps, warm = metrics.schedule(6_000_000_000, 524_288, 0.01)
    rate = metrics.learning_rate(F.col("id"), 1e-3, warm, steps, 0.1)
    return spark.range(0, steps + 10).select(F.col("id").alias("step"), F.round(rate * 1e12).cast("bigint").alias("rate_e12"))


def evaluation(spark, root):
    docs = table(spark, root, "documents").where("text is not null")
    label = F.when(F.expr("doc_id % 11 = 0"), -100).otherwise(F.expr("cast(doc_id % 1667 as int)"))
    scored = docs.select(label.alias("label"), (F.expr("octet_length(text) % 64") / 16.0).alias("nll"))
    sizes = table(spark, root, "tok_vocab").select(F.col("token_id").alias("label"), F.when(F.col("is_special"), 0).otherwise(F.octet_length("piece")).alias("n_bytes"))
    got = metrics.evaluate(scored, sizes)
    return got.withColumns({c: F.round(c, 9) for c in ("loss", "bpb")})


def top_scores(spark, root):
    vectors = table(spark, root, "embeddings")
    rounded = F.transform("embedding", lambda v: F.floor(v * 4).cast("int"))
    return vectors.select("vec_id", F.inline(metrics.top_k_of(rounded, 5)))


def training_log(spark, root):
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(LOG)], "n int, value string")
    return metrics.read_log(lines)


def stream_ingest(spark, root):
    """The raw records taken in as a stream; what is kept."""
    out = scratch(spark, "ingest")
    ingest.ingest(spark, f"{root}/raw_records.parquet", out, table(spark, root, "domain_config")).awaitTermination()
    return spark.read.parquet(f"{out}/kept").select("domain", "pos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_text, clean_reasons, dedup_exact, dedup_counts, incremental_load, document_ids, byte_budget, slot_budget, domain_status, domain_result, domain_outcome, manifest,
        val_sizes, val_split, reservoir, val_pick, smoke_subset, smoke_val, segment_sample, tokenizer_text, epoch_order, mix_order, mix_stats, mix_exhausted, stream_layout, batch_layout,
        presplit, word_frequencies, pair_counts, bpe_training, token_ids, token_bytes, token_round_trip, token_windows, last_window, special_tokens, token_shards,
        agent_windows, rendered_items, padded_batches, supervision, plain_conversations, fitting_conversations, prompt_tokens, sft_samples, sft_counts, hold_out,
        verify_records, verify_files, verify_smoke, verify_shares, written_corpus, verify_lines, strict_records, conversation_file, parquet_rows, chosen_domains, corpus_bytes, credited_tokens, lenient_lines, learning_rates, evaluation, top_scores, training_log, stream_ingest,
    )
}


# ---------------------------------------------------------------------------------------------- SQL

_SPACE = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_CTE = f"""
c AS (SELECT r.domain, slot, pos, raw, TRY(decode(raw)) AS d, coalesce(min_doc_bytes, 200) AS least
      FROM raw_records r LEFT JOIN domain_config USING (domain) WHERE raw IS NOT NULL),
s AS (SELECT *, trim(replace(replace(d, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_SPACE}) AS t FROM c),
x AS (SELECT domain, slot, pos, t, CASE WHEN d IS NULL THEN 'utf8' WHEN contains(t, chr(0)) THEN 'control_char'
             WHEN strlen(t) < least THEN 'too_short' END AS reason FROM s),
k AS (SELECT domain, slot, pos, t AS text FROM x WHERE reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY domain, sha256(t) ORDER BY pos) = 1),
z AS (SELECT *, (strlen(json_object('text', text, 'source', domain, 'id', domain || '/000000000')::VARCHAR) + 1)::BIGINT AS line_bytes FROM k),
l AS (SELECT *, (row_number() OVER w - 1)::BIGINT AS n, coalesce(sum(line_bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before
      FROM z WINDOW w AS (PARTITION BY domain ORDER BY pos)),
g AS (SELECT domain, round_even({BUDGET_TOKENS}::DOUBLE * share * bytes_per_token, 0)::BIGINT AS target_bytes FROM domain_config),
b AS (SELECT l.*, domain || '/' || lpad(n::VARCHAR, 9, '0') AS id FROM l)
"""
_MIX = f"""
d AS (SELECT domain, doc_id, (strlen(text) // 4 + 1)::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL),
q AS (SELECT d.*, coalesce(sum(n_tokens) OVER (PARTITION BY d.domain ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / share AS mix_key
      FROM d JOIN domain_config USING (domain)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before,
             (row_number() OVER w - 1)::BIGINT AS place FROM q WINDOW w AS (ORDER BY mix_key, domain, doc_id)),
m AS (SELECT * FROM o WHERE tokens_before < {MIX_TOKENS})
"""
_HASH8 = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0"
_BODY = """
a AS (SELECT conv_id, messages AS m, [x FOR x IN messages IF x.role <> 'system'] AS said, [x FOR x IN messages IF x.role = 'user'] AS u FROM (SELECT DISTINCT conv_id, messages FROM sft_toy)),
bd AS (SELECT conv_id, u, CASE WHEN said[1].role = 'user' THEN said[2:] ELSE said END AS body FROM a),
tn AS (SELECT conv_id, u, body, unnest(range(1, len(body) + 1)) AS i FROM bd),
tu AS (SELECT conv_id, u, body, i FROM tn WHERE body[i].role = 'assistant')
"""
#: The documents' tokens; the stream of them; agent windows as samples; what is left of a rendered one under the limit.
_MD5 = "md5(array_to_string([__i::VARCHAR FOR __i IN {0}], ','))"
_STREAM = f"""{sqltext.token_ids("documents")}, __doc AS (SELECT doc_id, list_prepend({sqltext.special(0)}, ids) AS ids FROM documents JOIN __ids USING (text))"""
_FLAT = """o AS (SELECT doc_id, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM __doc),
s AS (SELECT start + i - 1 AS p, ids[i] AS id FROM (SELECT start, ids, unnest(range(1, len(ids) + 1)) AS i FROM o))"""
_SAMPLE_OF = f"""smp AS (SELECT conv_id, turn, list_concat([{{'role': 'system', 'content': '{SYSTEM}', 'tool_calls': NULL, 'tool_call_id': NULL}}],
    CASE WHEN len(u) > 0 THEN [{{'role': 'user', 'content': coalesce(u[1].content, ''), 'tool_calls': NULL, 'tool_call_id': NULL}}] ELSE [] END,
    [{{'role': x.role, 'content': x.content, 'tool_calls': x.tool_calls, 'tool_call_id': x.tool_call_id}} FOR x IN h]) AS sample FROM w)"""
_SAMPLES = f"{_BODY}, w AS (SELECT conv_id, (i - 1)::INT AS turn, u, body[greatest(1, i - 6):i] AS h FROM tu), {_SAMPLE_OF}"
_CUT = f"""cut AS (SELECT * FROM (SELECT conv_id, turn, CASE WHEN len(ids) > {BLOCK} THEN list_concat(ids[:1], ids[-{BLOCK - 1}:]) ELSE ids END AS ids,
    CASE WHEN len(ids) > {BLOCK} THEN list_concat(mask[:1], mask[-{BLOCK - 1}:]) ELSE mask END AS mask FROM __rendered) WHERE list_sum(mask) > 0)"""


_DOMAINS = ("code_issues", "code_python", "code_shell", "cosmopedia", "qa_stackexchange", "terminal_docs", "web_dclm", "web_edu")


def _drawn_slots(most: int = 4000) -> str:
    """VALUES of (domain, arrival, slot) hits among the first ``most`` arrivals: each arrival after the reservoir is full draws one of the places so far."""
    rows = []
    for domain in _DOMAINS:
        draws = random.Random(split.SEED + zlib.crc32(domain.encode()))
        places = [draws.randrange(n) for n in range(RESERVOIR + 1, most + 1)]
        rows += [f"('{domain}', {RESERVOIR + k}, {j})" for k, j in enumerate(places) if j < RESERVOIR]
    return ", ".join(rows)


def _drawn_val() -> str:
    """VALUES of (domain, held, place, slot): the validation slots of a domain with ``held`` of at most RESERVOIR rows in its reservoir, in their order.

    As the least validation size is above the reservoir, all slots are drawn, or all but one where no row is beyond it.
    """
    rows = []
    for domain in _DOMAINS:
        for held in range(2, RESERVOIR + 1):
            for k in {held - 1, held} if held == RESERVOIR else {held - 1}:
                picked = random.Random(split.SEED + zlib.crc32(f"{domain}:val".encode())).sample(range(held), k)
                rows += [f"('{domain}', {held}, {k}, {i}, {s})" for i, s in enumerate(sorted(picked))]
    return ", ".join(rows)


_SMOKE = f"""a AS (SELECT b.*, sum(line_bytes) OVER (PARTITION BY domain) AS actual FROM b),
        h AS (SELECT *, actual / {DIVISOR} AS goal FROM a WHERE {_HASH8.format("'smoke:' || id")} < least(1.0, actual / {DIVISOR} / greatest(1, actual) * 1.15)),
        p AS (SELECT *, coalesce(sum(line_bytes) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
        o AS (SELECT domain, pos, id FROM p WHERE before < goal)"""
_SUBSET = f"""SELECT * FROM o UNION ALL
        SELECT domain, pos, id FROM a WHERE domain NOT IN (SELECT domain FROM o) AND bytes_before < actual / {DIVISOR} AND n < 50"""
_RESERVOIR = f"""r AS (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY doc_id) - 1 AS t, count(*) OVER (PARTITION BY domain) AS n FROM documents), h(domain, t, slot) AS (VALUES {_drawn_slots()}),
        s AS (SELECT domain, doc_id, t, n, CASE WHEN t < {RESERVOIR} THEN t ELSE coalesce(h.slot, -1) END AS slot FROM r LEFT JOIN h USING (domain, t)),
        o AS (SELECT *, CASE WHEN slot >= 0 THEN lead(t) OVER (PARTITION BY domain, slot ORDER BY t) END AS gone FROM s)"""
_FIT = f"""a AS (SELECT DISTINCT conv_id, messages FROM sft_toy),
        smp AS (SELECT conv_id, [{{'role': x.role, 'content': x.content, 'tool_calls': []::STRUCT(id VARCHAR, type VARCHAR, function STRUCT(name VARCHAR, arguments VARCHAR))[], 'tool_call_id': NULL::VARCHAR}} FOR x IN messages IF x.role IN ('system', 'user', 'assistant')] AS sample, len(messages) AS n FROM a),
        {sqltext.rendered("smp", "conv_id")},
        g AS (SELECT smp.conv_id, n, len([x FOR x IN sample IF x.role = 'assistant' AND coalesce(x.content, '') <> '']) > 0 AS answers, CASE WHEN list_sum(mask) > 0 THEN len(ids) END AS n_tokens FROM smp LEFT JOIN __rendered USING (conv_id)),
        v AS (SELECT conv_id, CASE WHEN n < 2 OR NOT answers OR n_tokens IS NULL THEN 'malformed' WHEN n_tokens > {BLOCK} THEN 'long' ELSE 'kept' END AS verdict, n_tokens FROM g),
        k AS (SELECT *, count(*) FILTER (verdict = 'kept') OVER (ORDER BY conv_id) AS before_and_this FROM v),
        q AS (SELECT * FROM k WHERE before_and_this - (verdict = 'kept')::INT < greatest(1, (SELECT count(*) FROM a) // 2))"""
_LOG_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(LOG))
#: The schedule of 6,000,000,000 tokens, 524,288 a step, a hundredth of it warm-up.
_STEPS, _WARM = "greatest(2, 6000000000 // 524288)", "greatest(1, least(6000000000 // 524288 - 1, floor(6000000000 // 524288 * 0.01)::BIGINT))"
_NAMES = ", ".join(f"('{name}', {i})" for i, name in enumerate(
    ["<|bos|>", *(f"<|{x}_{y}|>" for x in ("user", "assistant", "system", "tool_call", "tool_result") for y in ("start", "end")), *(f"<|fim_{x}|>" for x in ("prefix", "suffix", "middle")), *(f"<|reserved_{i}|>" for i in range(32))]
))

SQL: dict[str, str] = {
    "clean_text": f"WITH {_CTE} SELECT domain, slot, pos, CASE WHEN reason IS NULL THEN t END AS text, reason FROM x",
    "clean_reasons": f"WITH {_CTE} SELECT domain, reason, count(*) AS n FROM x GROUP BY ALL",
    "dedup_exact": f"WITH {_CTE} SELECT domain, pos, text FROM k",
    "dedup_counts": f"WITH {_CTE} SELECT domain, count(*) AS n, count(DISTINCT t) AS n_distinct, count(*) - count(DISTINCT t) AS n_duplicate FROM x WHERE reason IS NULL GROUP BY domain",
    "incremental_load": f"""WITH {_CTE}, r AS (SELECT domain, pos, sha256(t) AS h FROM x WHERE reason IS NULL)
        SELECT domain, min(pos) AS pos FROM r WHERE pos % 3 = 0 AND (domain, h) NOT IN (SELECT (domain, h) FROM r WHERE pos % 3 <> 0) GROUP BY domain, h""",
    "document_ids": f"WITH {_CTE} SELECT domain, pos, id, line_bytes, bytes_before FROM b",
    "byte_budget": f"WITH {_CTE} SELECT b.domain, pos, id FROM b JOIN g USING (domain) WHERE bytes_before < target_bytes",
    "slot_budget": f"""WITH {_CTE}, t AS (SELECT b.domain, (pos % 2)::INT AS slot, pos, line_bytes, target_bytes FROM b JOIN g USING (domain)),
        n AS (SELECT domain, count(DISTINCT slot) AS ns FROM t GROUP BY domain),
        r AS (SELECT t.*, ns, least(target_bytes, floor(target_bytes / ns * (slot + 1))::BIGINT) AS goal,
              coalesce(sum(line_bytes) OVER (PARTITION BY t.domain, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN n USING (domain)),
        f AS (SELECT * FROM r WHERE slot = 0 AND before < goal), h AS (SELECT domain, sum(line_bytes) AS have FROM f GROUP BY domain)
        SELECT domain, slot, pos FROM f UNION ALL
        SELECT r.domain, slot, pos FROM r LEFT JOIN h USING (domain) WHERE slot = 1 AND before < goal - coalesce(have, 0)""",
    "domain_status": f"""WITH {_CTE}, h AS (SELECT b.domain, sum(line_bytes)::BIGINT AS kb FROM b JOIN g USING (domain) WHERE bytes_before < target_bytes GROUP BY b.domain)
        SELECT g.domain, target_bytes, coalesce(kb, 0) AS kept_bytes, CASE WHEN coalesce(kb, 0) < target_bytes * 0.95 THEN 'partial' ELSE 'complete' END AS status
        FROM g LEFT JOIN h USING (domain)""",
    "domain_result": f"""WITH {_CTE}, y AS (SELECT domain, count(*) AS n_read, count(*) FILTER (reason = 'utf8') AS utf8, count(*) FILTER (reason = 'too_short') AS too_short,
        count(*) FILTER (reason = 'control_char') AS control_char, count(*) FILTER (reason IS NULL) AS good FROM x GROUP BY domain),
        w AS (SELECT domain, count(*) AS n_kept, sum(line_bytes)::BIGINT AS bytes FROM b GROUP BY domain)
        SELECT y.domain, n_read, coalesce(n_kept, 0) AS n_kept, utf8, too_short, good - coalesce(n_kept, 0) AS duplicate, control_char, coalesce(bytes, 0)::BIGINT AS bytes
        FROM y LEFT JOIN w USING (domain)""",
    "manifest": f"""WITH {_CTE}, p AS (SELECT b.domain, count(*) AS documents, sum(line_bytes)::BIGINT AS bytes FROM b GROUP BY b.domain),
        e AS (SELECT p.*, floor(bytes / bytes_per_token)::BIGINT AS estimated_tokens FROM p JOIN domain_config USING (domain)),
        t AS (SELECT NULL::VARCHAR AS domain, sum(documents)::BIGINT AS documents, sum(bytes)::BIGINT AS bytes, sum(estimated_tokens)::BIGINT AS estimated_tokens FROM e),
        u AS (SELECT * FROM e UNION ALL SELECT * FROM t)
        SELECT u.domain, u.documents, u.bytes, coalesce(u.bytes / t.bytes, 0.0) AS actual_share, u.estimated_tokens FROM u, t""",
    "val_sizes": """SELECT domain, n, least(greatest(200, least(20000, round_even(n * 0.005, 0))), least(n, 20000), greatest(0, n - 1))::BIGINT AS k
        FROM (SELECT split_part(id, '/', 1) AS domain, count(*) AS n FROM corpus_records GROUP BY 1)""",
    "val_split": """WITH r AS (SELECT domain, doc_id::VARCHAR AS id, count(*) OVER (PARTITION BY domain) AS n,
        row_number() OVER (PARTITION BY domain ORDER BY sha256('val:' || doc_id::VARCHAR), doc_id::VARCHAR) AS rn FROM documents),
        v AS (SELECT *, CASE WHEN rn <= least(greatest(200, least(20000, round_even(n * 0.005, 0))), least(n, 20000), greatest(0, n - 1)) THEN 'val' ELSE 'train' END AS split FROM r)
        SELECT domain, split, count(*) AS n, min(id) AS first_id FROM v GROUP BY ALL""",
    "val_pick": f"""WITH {_RESERVOIR}, d(domain, held, k, i, slot) AS (VALUES {_drawn_val()}),
        p AS (SELECT o.domain, doc_id, t, n, o.slot, gone, i FROM o LEFT JOIN d ON o.slot >= 0 AND gone IS NULL AND d.domain = o.domain AND d.slot = o.slot AND d.held = least(n, {RESERVOIR}) AND d.k = least(200, least(n, {RESERVOIR}), n - 1))
        SELECT domain, doc_id, CASE WHEN i IS NULL THEN 'train' ELSE 'val' END AS split,
               CASE WHEN i IS NOT NULL THEN i WHEN slot >= 0 AND gone IS NULL THEN n + slot WHEN slot < 0 THEN t ELSE gone END AS split_order FROM p""",
    "smoke_val": f"""WITH {_CTE}, {_SMOKE}, sub AS ({_SUBSET}), z1 AS (SELECT *, count(*) OVER (PARTITION BY domain) AS m, row_number() OVER (PARTITION BY domain ORDER BY sha256('smoke val:' || id), id) AS rk FROM sub)
        SELECT domain, pos, CASE WHEN rk <= least(greatest(1, least(m, greatest(round_even(m * 0.005, 0), 20))), greatest(1, m - 1)) THEN 'val' ELSE 'train' END AS split FROM z1""",
    "domain_outcome": f"""WITH {_CTE}, y AS (SELECT domain, count(*) AS n_read, count(*) FILTER (reason = 'utf8') AS utf8, count(*) FILTER (reason = 'too_short') AS too_short,
        count(*) FILTER (reason = 'control_char') AS control_char, count(*) FILTER (reason IS NULL) AS good FROM x GROUP BY domain),
        w AS (SELECT domain, count(*) AS n_kept, sum(line_bytes)::BIGINT AS bytes FROM b GROUP BY domain),
        j AS (SELECT g.domain, target_bytes, coalesce(n_read, 0) AS n_read, coalesce(n_kept, 0) AS n_kept, coalesce(utf8, 0) AS utf8, coalesce(too_short, 0) AS too_short, coalesce(good, 0) - coalesce(n_kept, 0) AS duplicate,
            coalesce(control_char, 0) AS control_char, coalesce(bytes, 0)::BIGINT AS bytes FROM g LEFT JOIN y USING (domain) LEFT JOIN w USING (domain)),
        v AS (SELECT *, least(greatest(200, least(20000, round_even(n_kept * 0.005, 0))), least(n_kept, 20000), greatest(0, n_kept - 1))::BIGINT AS docs_val FROM j)
        SELECT *, n_kept - docs_val AS docs_train, CASE WHEN bytes < target_bytes * 0.95 THEN 'partial' ELSE 'complete' END AS status FROM v""",
    "prompt_tokens": f"""WITH {_BODY}, w AS (SELECT conv_id, (i - 1)::INT AS turn, u, body[greatest(1, i - 6):i] AS h FROM tu), {_SAMPLE_OF}, pre AS (SELECT conv_id, turn, sample[:-2] AS sample FROM smp),
        {sqltext.rendered("pre", "conv_id, turn")}, f AS (SELECT conv_id, turn, list_append(ids, {sqltext.special(3)}) AS ids FROM __rendered),
        c2 AS (SELECT conv_id, turn, CASE WHEN len(ids) > {BLOCK} THEN list_concat(ids[:1], ids[-{BLOCK - 1}:]) ELSE ids END AS ids FROM f)
        SELECT conv_id, turn, len(ids)::INT AS n_tokens, {_MD5.format("ids")} AS ids_md5 FROM c2""",
    "sft_samples": f"""WITH {_FIT} SELECT conv_id, n_tokens::INT AS n_tokens, row_number() OVER (ORDER BY sha256('7:' || conv_id::VARCHAR)) - 1 AS place FROM q WHERE verdict = 'kept'""",
    "sft_counts": f"""WITH {_FIT} SELECT verdict, count(*) AS n FROM q GROUP BY verdict""",
    "reservoir": f"""WITH {_RESERVOIR}
        SELECT domain, t, slot, slot >= 0 AND gone IS NULL AS resident, CASE WHEN slot < 0 THEN t ELSE gone END AS write_order FROM o""",
    "smoke_subset": f"""WITH {_CTE}, {_SMOKE} {_SUBSET}""",
    "epoch_order": "SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('1235:' || doc_id::VARCHAR)) - 1 AS place FROM documents) WHERE place >= 10",
    "mix_order": f"WITH {_MIX} SELECT doc_id, domain, place, tokens_before FROM m",
    "mix_stats": f"""WITH {_MIX}, t AS (SELECT c.domain, share AS target_share, coalesce(sum(n_tokens), 0)::BIGINT AS tokens, count(n_tokens) AS documents
        FROM domain_config c LEFT JOIN m USING (domain) GROUP BY ALL), y AS (SELECT *, coalesce(tokens / sum(tokens) OVER (), 0.0) AS actual_share FROM t)
        SELECT domain, target_share, actual_share, (actual_share - target_share) * 100 AS diff_pp, tokens, documents FROM y""",
    "mix_exhausted": f"""WITH {_MIX}, e AS (SELECT c.domain, coalesce(sum(n_tokens), 0)::BIGINT / any_value(share) AS k FROM domain_config c LEFT JOIN d USING (domain) GROUP BY c.domain)
        SELECT e.domain FROM e WHERE (SELECT coalesce(sum(n_tokens), 0) FROM q WHERE mix_key < e.k OR (mix_key = e.k AND q.domain <= e.domain)) < (SELECT sum(n_tokens) FROM d)::BIGINT * 3 // 4""",
    "stream_layout": f"""WITH {_MIX}, f AS (SELECT doc_id, n_tokens, coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d)
        SELECT doc_id, "offset", "offset" // {SHARD} AS first_shard, ("offset" + n_tokens - 1) // {SHARD} AS last_shard,
               "offset" // {BLOCK} AS first_block, ("offset" + n_tokens - 1) // {BLOCK} AS last_block FROM f""",
    "batch_layout": """SELECT doc_id, place, place // 16 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
        WHERE place // 16 < n // 16""",
    "presplit": f"""WITH p AS (SELECT doc_id, {sqltext.pieces("text")} AS pieces FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(pieces)::INT AS n_pieces, md5(array_to_string(pieces, chr(31))) AS pieces_md5 FROM p""",
    "word_frequencies": f"""SELECT word, count(*) AS n FROM (SELECT unnest({sqltext.pieces("text")}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word""",
    "pair_counts": f"""WITH w AS (SELECT hex(encode(word)) AS x, count(*) AS n FROM (SELECT unnest({sqltext.pieces("text")}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word),
        p AS (SELECT x[2*i+1:2*i+2] AS a, x[2*i+3:2*i+4] AS b, n FROM (SELECT x, n, unnest(range(0, len(x) // 2 - 1)) AS i FROM w))
        SELECT ('0x' || a)::INT AS "left", ('0x' || b)::INT AS "right", sum(n)::BIGINT AS n FROM p GROUP BY ALL""",
    "token_ids": f"""WITH {_STREAM} SELECT doc_id, len(ids)::INT AS n_tokens, {_MD5.format("ids")} AS ids_md5 FROM __doc""",
    "token_bytes": f"""WITH {_STREAM}, n AS (SELECT unnest(ids) AS token_id FROM __doc), k AS (SELECT token_id, count(*) AS n FROM n GROUP BY token_id),
        v AS (SELECT i::INT AS token_id FROM (SELECT unnest(range(0, 256 + (SELECT count(*) FROM tok_merges) + {len(tokenizer.SPECIAL_TOKENS)})) AS i))
        SELECT token_id, CASE WHEN is_special OR piece IS NULL THEN 0 ELSE octet_length(piece) END::INT AS n_bytes, coalesce(n, 0) AS n FROM v LEFT JOIN tok_vocab USING (token_id) LEFT JOIN k USING (token_id)""",
    "token_windows": f"""WITH {_STREAM}, {_FLAT}, b AS (SELECT p // {BLOCK} AS block, p, id FROM s), x AS (SELECT block, list(id ORDER BY p) AS ids FROM b GROUP BY block),
        l AS (SELECT p // {BLOCK} AS block, list(id ORDER BY p) AS ids FROM (SELECT p - 1 AS p, id FROM s WHERE p > 0) GROUP BY 1)
        SELECT block, {_MD5.format("x.ids")} AS inputs_md5, {_MD5.format("l.ids")} AS labels_md5 FROM x JOIN l USING (block) WHERE block < ((SELECT count(*) FROM s) - 1) // {BLOCK}""",
    "last_window": f"""WITH {_STREAM}, {_FLAT}, k AS (SELECT (count(*) - 1) // {BLOCK} - 1 AS block FROM s)
        SELECT block, (SELECT {_MD5.format("list(id ORDER BY p)")} FROM s WHERE p // {BLOCK} = block) AS inputs_md5, (SELECT {_MD5.format("list(id ORDER BY p)")} FROM s WHERE p > 0 AND (p - 1) // {BLOCK} = block) AS labels_md5 FROM k""",
    "special_tokens": f"""SELECT name, (256 + (SELECT count(*) FROM tok_merges) + i)::INT AS token_id FROM (VALUES {_NAMES}) AS v(name, i)""",
    "token_shards": f"""WITH {_STREAM}, {_FLAT}, x AS (SELECT (p // {SHARD})::INT AS shard, list(id ORDER BY p) AS ids FROM s GROUP BY 1)
        SELECT shard, (shard * {SHARD})::BIGINT AS "offset", len(ids)::INT AS n_tokens, {_MD5.format("ids")} AS tokens_md5 FROM x""",
    "token_round_trip": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "agent_windows": f"""WITH {_BODY}, w AS (SELECT conv_id, (i - 1)::INT AS turn, u, body[greatest(1, i - 6):i] AS h FROM tu)
        SELECT conv_id, turn, (len(h) + CASE WHEN len(u) > 0 THEN 2 ELSE 1 END)::INT AS n_messages,
               md5(array_to_string(list_concat(['system:{SYSTEM}'], CASE WHEN len(u) > 0 THEN ['user:' || coalesce(u[1].content, '')] ELSE [] END,
                   [x.role || ':' || coalesce(x.content, '-') FOR x IN h]), '|')) AS content_md5 FROM w""",
    "rendered_items": f"""WITH {_SAMPLES}, {sqltext.rendered("smp", "conv_id, turn")}, {_CUT}
        SELECT conv_id, turn, len(ids)::INT AS n_tokens, {_MD5.format("ids[:-2]")} AS inputs_md5, {_MD5.format("[CASE WHEN mask[i] = 1 THEN ids[i] ELSE -100 END FOR i IN range(2, len(ids) + 1)]")} AS labels_md5 FROM cut""",
    "padded_batches": f"""WITH {_SAMPLES}, {sqltext.rendered("smp", "conv_id, turn")}, {_CUT},
        t AS (SELECT conv_id, turn, conv_id // 8 AS batch, ids[:-2] AS a, [CASE WHEN mask[i] = 1 THEN ids[i] ELSE -100 END FOR i IN range(2, len(ids) + 1)] AS b FROM cut),
        wide AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS n FROM t), f AS (SELECT conv_id, turn, n, list_concat(a, [0 FOR i IN range(len(a), n)]) AS a, list_concat(b, [-100 FOR i IN range(len(b), n)]) AS b FROM wide)
        SELECT conv_id, turn, n::INT AS n, {_MD5.format("a")} AS inputs_md5, {_MD5.format("b")} AS labels_md5 FROM f""",
    "supervision": f"""WITH {_SAMPLES}, {sqltext.rendered("smp", "conv_id, turn")}, {_CUT}, f AS (SELECT * FROM cut ORDER BY conv_id, turn LIMIT 500)
        SELECT count(*) AS samples, avg(len(ids)) AS mean_tokens, sum(list_sum(mask)) / sum(len(ids)) AS supervised_share FROM f""",
    "fitting_conversations": f"""WITH {_FIT} SELECT verdict, count(*) AS n, sum(n_tokens)::BIGINT AS n_tokens FROM v GROUP BY verdict""",
    "plain_conversations": """WITH a AS (SELECT conv_id, len(messages) AS n, [x FOR x IN messages IF x.role IN ('system', 'user', 'assistant')] AS s FROM (SELECT DISTINCT conv_id, messages FROM sft_toy))
        SELECT conv_id, CASE WHEN n >= 2 AND len([x FOR x IN s IF x.role = 'assistant' AND coalesce(x.content, '') <> '']) > 0 THEN 'ok' ELSE 'malformed' END AS shape, len(s)::INT AS n_messages FROM a""",
    "hold_out": """SELECT CASE WHEN conv_id = (SELECT max(conv_id) FROM sft_toy) THEN 'val' ELSE 'train' END AS split, count(*) AS n, max(conv_id) AS last
        FROM (SELECT DISTINCT conv_id FROM sft_toy) GROUP BY 1""",
    "verify_records": """WITH r AS (SELECT *, split_part(file_name, '/', 1) AS domain FROM corpus_records),
        j AS (SELECT r.*, coalesce(min_doc_bytes, 200) AS least FROM r LEFT JOIN domain_config USING (domain)),
        i AS (SELECT id, count(*) AS k FROM r GROUP BY id), d AS (SELECT domain, id, bool_or(split = 'train') AS t, bool_or(split = 'val') AS v FROM r GROUP BY ALL),
        h AS (SELECT domain, text, count(*) AS k FROM r WHERE text IS NOT NULL GROUP BY ALL),
        u AS (SELECT 'C3' AS "check", count(*) FILTER (source IS DISTINCT FROM domain) AS bad, count(*) AS n FROM j
        UNION ALL SELECT 'C6', count(*) FILTER (text IS NULL OR contains(text, chr(13)) OR contains(text, chr(0))), count(*) FROM j
        UNION ALL SELECT 'C7', count(*) FILTER (strlen(text) < least), count(*) FROM j
        UNION ALL SELECT 'C4', (sum(k) - count(id))::BIGINT, sum(k)::BIGINT FROM i
        UNION ALL SELECT 'C5', count(*) FILTER (t AND v), count(*) FROM d
        UNION ALL SELECT 'C8', sum(k - 1)::BIGINT, sum(k)::BIGINT FROM h)
        SELECT "check", bad = 0 AS ok, bad, n FROM u""",
    "verify_files": """WITH f AS (SELECT split_part(file_name, '/', 1) AS domain, split || '_000.jsonl' AS name, sum(strlen(text))::BIGINT * 400 AS bytes FROM corpus_records WHERE text IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
        s AS (SELECT domain, bool_or(name LIKE 'train#_%' ESCAPE '#') AND bool_or(name LIKE 'val#_%' ESCAPE '#') AS present, sum(bytes)::BIGINT AS bytes FROM f GROUP BY domain),
        m AS (SELECT domain, s.bytes + (domain = 'web_edu')::INT AS want FROM domain_config c LEFT JOIN s USING (domain) WHERE domain <> 'code_shell'),
        j AS (SELECT m.domain AS md, s.domain AS sd, present, want, bytes FROM m FULL JOIN s ON m.domain = s.domain),
        u AS (SELECT 'C1' AS "check", count(*) FILTER (md IS NOT NULL AND NOT coalesce(present, false)) AS bad, count(md) AS n FROM j
        UNION ALL SELECT 'C10', count(*) FILTER (bytes > 536870912), count(*) FROM f
        UNION ALL SELECT 'C11', count(*) FILTER (want IS DISTINCT FROM bytes), count(*) FROM j)
        SELECT "check", bad = 0 AS ok, bad, n FROM u""",
    "verify_smoke": f"""WITH {_CTE}, d AS (SELECT domain, coalesce(sum(line_bytes), 0)::BIGINT AS bytes FROM (SELECT DISTINCT domain FROM x) LEFT JOIN b USING (domain) GROUP BY domain),
        o AS (SELECT count(*) FILTER (domain = 'web_edu') + CASE WHEN sum(bytes) FILTER (domain <> 'web_edu') BETWEEN 30000000 AND 80000000 THEN 0 ELSE 1 END AS bad, count(*) AS n FROM d)
        SELECT 'C12' AS "check", bad = 0 AS ok, bad::BIGINT AS bad, n FROM o""",
    "strict_records": "SELECT id, source, md5(text) AS text_md5 FROM corpus_records WHERE id IS NOT NULL AND text <> '' AND source IS NOT NULL",
    "conversation_file": """SELECT len(messages)::INT AS n_messages, md5(array_to_string([x.role || ':' || coalesce(x.content, '-') FOR x IN messages], '|')) AS content_md5
        FROM (SELECT DISTINCT conv_id, messages FROM sft_toy) WHERE len(messages) > 0""",
    "parquet_rows": "SELECT md5(text) AS raw_md5, count(*) AS n FROM documents GROUP BY text",
    "chosen_domains": f"WITH {_CTE} SELECT domain, count(*) AS n FROM x WHERE domain IN ('code_python', 'web_edu') GROUP BY domain",
    "corpus_bytes": f"""WITH {_CTE} SELECT (SELECT sum(line_bytes)::BIGINT FROM b) AS n_bytes, (ceil((SELECT sum(target_bytes) FROM g) * 1.05) + 2147483648)::BIGINT AS disk_needed""",
    "credited_tokens": "SELECT d.domain, sum(strlen(text) // 4 + 1)::BIGINT AS n_tokens FROM documents d JOIN domain_config c USING (domain) WHERE text IS NOT NULL GROUP BY d.domain",
    "verify_shares": f"""WITH {_CTE}, p AS (SELECT b.domain, sum(line_bytes) AS bytes FROM b GROUP BY b.domain), y AS (SELECT p.*, share, sum(bytes) OVER () AS ab, sum(share) OVER () AS asum FROM p JOIN domain_config USING (domain)),
        o AS (SELECT count(*) FILTER (abs(bytes / ab - share / asum) * 100 > 5) AS bad, count(*) AS n FROM y)
        SELECT 'C9' AS "check", CASE WHEN n > 0 THEN bad = 0 END AS ok, bad, n FROM o""",
    "written_corpus": f"WITH {_CTE} SELECT domain, count(*) AS n_lines, sum(line_bytes)::BIGINT AS n_bytes FROM b GROUP BY domain",
    "verify_lines": """WITH r AS (SELECT ends_with(id, '3') OR ends_with(id, '5') OR ends_with(id, '7') AS b FROM corpus_records WHERE id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL)
        SELECT 'C2' AS "check", count(*) FILTER (b) = 0 AS ok, count(*) FILTER (b) AS bad, count(*) AS n FROM r""",
    "lenient_lines": "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM corpus_records WHERE id IS NOT NULL AND text IS NOT NULL AND NOT ends_with(id, '5')",
    "learning_rates": f"""SELECT step, round(CASE WHEN step < {_WARM} THEN 1e-3 * (step + 1) / {_WARM} WHEN step >= {_STEPS} THEN 1e-3 * 0.1
        ELSE 1e-4 + 0.5 * (1 + cos(pi() * ((step - {_WARM}) / ({_STEPS} - {_WARM})))) * (1e-3 - 1e-4) END * 1e12)::BIGINT AS rate_e12 FROM (SELECT unnest(range(0, {_STEPS} + 10)) AS step)""",
    "evaluation": """WITH s AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -100 ELSE (doc_id % 1667)::INT END AS label, strlen(text) % 64 / 16.0 AS nll FROM documents WHERE text IS NOT NULL),
        v AS (SELECT token_id AS label, CASE WHEN is_special THEN 0 ELSE octet_length(piece) END AS n_bytes FROM tok_vocab),
        a AS (SELECT sum(nll)::DOUBLE AS t, count(*) AS n_tokens, coalesce(sum(n_bytes), 0)::BIGINT AS n_bytes FROM s LEFT JOIN v USING (label) WHERE label <> -100)
        SELECT round(t / n_tokens, 9) AS loss, round(t / ln(2.0::DOUBLE) / n_bytes, 9) AS bpb, n_tokens, n_bytes FROM a""",
    "top_scores": """WITH e AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS "index", embedding FROM embeddings),
        f AS (SELECT vec_id, "index", floor(embedding["index" + 1] * 4)::INT AS score FROM e)
        SELECT vec_id, "index", score FROM f QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY score DESC) <= 5""",
    "training_log": f"""WITH v(n, value) AS (VALUES {_LOG_VALUES}), p AS (SELECT value, 'step\\s+(\\d+).*?train loss = ([\\d.]+).*?val loss = ([\\d.]+).*?bpb = ([\\d.]+)' AS a,
        '\\[epoch end\\].*?step\\s+(\\d+).*?val loss = ([\\d.]+).*?bpb = ([\\d.]+)' AS z FROM v)
        SELECT 'point' AS kind, regexp_extract(value, '{metrics.LOG_LINE}', 1)::INT AS step, regexp_extract(value, '{metrics.LOG_LINE}', 2)::DOUBLE AS train_loss,
               regexp_extract(value, '{metrics.LOG_LINE}', 3)::DOUBLE AS val_loss, regexp_extract(value, '{metrics.LOG_LINE}', 4)::DOUBLE AS bpb
        FROM p WHERE regexp_matches(value, '{metrics.LOG_LINE}') AND NOT contains(value, 'epoch end')
        UNION ALL SELECT 'final', regexp_extract(value, '{metrics.LOG_END}', 1)::INT, NULL::DOUBLE, regexp_extract(value, '{metrics.LOG_END}', 2)::DOUBLE, regexp_extract(value, '{metrics.LOG_END}', 3)::DOUBLE
        FROM p WHERE regexp_matches(value, '{metrics.LOG_END}')""",
    "stream_ingest": f"WITH {_CTE} SELECT domain, pos FROM k",
}
