import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, metrics
from millrace.operators.running import running_sum
from millrace.sources.shards import register


def stream(spark, lengths, seed=0):
    rng = random.Random(seed)
    docs = [(i, [rng.randint(0, 65_535) for _ in range(n)]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(docs, "k int, ids array<int>")
    return running_sum(df, [], ["k"], F.size("ids"), "offset"), [t for _, d in docs for t in d]


@pytest.mark.parametrize("block", [1, 3, 7, 10, 64])
def test_windows_overlap_by_one(spark, block):
    df, flat = stream(spark, [5, 0, 1, 20, 13, 2, 30])
    got = blocks.windows(df, block, len(flat)).orderBy("block").collect()
    n = (len(flat) - 1) // block
    assert [r.input_ids for r in got] == [flat[i * block : (i + 1) * block] for i in range(n)]
    assert [r.labels for r in got] == [flat[i * block + 1 : (i + 1) * block + 1] for i in range(n)]
    one = blocks.window_at(df, block, len(flat), -1).first()
    assert one.input_ids == got[-1].input_ids
    with pytest.raises(IndexError):
        blocks.window_at(df, block, len(flat), n)


def test_short_streams_and_bad_sizes(spark):
    df, flat = stream(spark, [3])
    with pytest.raises(ValueError):
        blocks.windows(df, 3, len(flat))
    with pytest.raises(ValueError):
        blocks.shards(df, 0)


@pytest.mark.parametrize("size", [1000, 33, 7])
def test_shards_round_trip_through_files(spark, tmp_path, size):
    df, flat = stream(spark, [50, 10, 0, 77, 1])
    register(spark)
    out = blocks.shards(df, size)
    (tmp_path / "train_000099.bin").write_bytes(b"stale")
    (tmp_path / "val_000000.bin").write_bytes(b"\x01\x00")
    out.select("shard", "tokens").write.format("token_shards").mode("append").option("path", str(tmp_path)).option("prefix", "train").save()
    read = spark.read.format("token_shards").option("path", str(tmp_path)).option("prefix", "train").load().orderBy("shard").collect()
    assert [t for r in read for t in r.tokens] == flat and [r.offset for r in read] == list(range(0, len(flat), size))
    assert (tmp_path / "val_000000.bin").exists() and not list(tmp_path.glob(".*"))


def test_ids_out_of_range_are_an_error(spark):
    for bad in ([1, 65_536], [-1]):
        df = spark.createDataFrame([(0, bad, 0)], "k int, ids array<int>, offset bigint")
        with pytest.raises(Exception, match="out of the range"):
            blocks.shards(df, 10).collect()


def test_batches(spark):
    rows = spark.range(10).select(F.col("id").alias("place"))
    assert blocks.batches(rows, "place", 4, True).agg(F.max("batch"), F.count("*")).first() == (1, 8)
    assert blocks.batches(rows, "place", 4, False).agg(F.max("batch"), F.count("*")).first() == (2, 10)
    # figures published for a run: shards and steps of 5,750,197,205 tokens
    assert -(-5_750_197_205 // 50_000_000) == 116 and (5_750_197_205 - 1) // 1024 // 16 // 32 == 10_967


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 2.0), (2, 1.0), (-100, 9.0), (7, 1.0)], "label int, nll double")
    sizes = spark.createDataFrame([(1, 3), (2, 1), (7, 0)], "label int, n_bytes int")
    r = metrics.evaluate(scored, sizes).first()
    assert r.n_tokens == 3 and r.n_bytes == 4 and math.isclose(r.loss, 4 / 3) and math.isclose(r.bpb, 4 / math.log(2) / 4)
    assert math.isnan(metrics.evaluate(scored, sizes.limit(0)).first().bpb) and metrics.evaluate(scored.limit(0), sizes).first().loss is None
    rate = metrics.learning_rate(F.col("id"), 1.0, 10, 100, 0.1)
    got = [r[0] for r in spark.range(105).orderBy("id").select(rate).collect()]
    assert math.isclose(got[0], 0.1) and math.isclose(got[10], 1.0) and math.isclose(got[55], 0.55) and got[104] == 0.1
    assert metrics.schedule(6_000_000_000, 524_288, 0.01) == (11444, 114) and metrics.accumulation(524_288, 16, 1024) == 32
    for bad in (lambda: metrics.learning_rate(F.col("id"), 1.0, 10, 10, 0.1), lambda: metrics.accumulation(10, 3, 1)):
        with pytest.raises(ValueError):
            bad()


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([(1, [5, 1, 5, 3, 3, 0])], "k int, v array<int>")
    assert [tuple(p) for p in df.select(metrics.top_k_of(F.col("v"), 3)).first()[0]] == [(0, 5), (2, 5), (3, 3), (4, 3)]
    rows = df.select("k", F.posexplode("v").alias("i", "s"))
    assert sorted(r.i for r in metrics.top_k(rows, ["k"], "s", 3).collect()) == [0, 2, 3, 4]


def test_logs_are_ordered_and_have_points(spark):
    lines = ["step 20 train loss = 2.0 val loss = 3.0 bpb = 1.0", "x", "step 10 train loss = 4.0 val loss = 5.0 bpb = 1.5", "[epoch end] step 30 val loss = 2.5 bpb = 0.9"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    assert [(r.kind, r.step) for r in metrics.read_log(df).collect()] == [("point", 10), ("point", 20), ("final", 30)]
    with pytest.raises(ValueError, match="no points"):
        metrics.read_log(df.where("n = 1"))
