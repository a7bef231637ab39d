import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import WHITESPACE, strip
from millrace.operators import corpus, split, verify
from millrace.operators.running import dense_rank, running_sum

RAW = "raw binary, domain string, slot int, pos bigint"
CONFIG = "domain string, share double, bytes_per_token double, min_doc_bytes int"


def clean_model(raw, least):
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None, "utf8"
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    if "\x00" in text:
        return None, "control_char"
    if len(text.encode()) < least:
        return None, "too_short"
    return text, None


def test_strip_takes_what_python_takes(spark):
    assert all(c.isspace() for c in WHITESPACE) and len(WHITESPACE) == 29
    texts = [f"{w}a{w}b{w}" for w in WHITESPACE] + ["", " ", "﻿a​"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip() for t in texts]


def test_clean_matches_a_model(spark):
    rng = random.Random(3)
    parts = [b"\r\n", b"\r", b"\n", b" ", b"\t", b"\x00", b"\xff", b"\xed\xa0\x80", "é".encode(), "漢".encode(), b"\xc2\xa0", b"x", b"yy"]
    rows = [(b"".join(rng.choice(parts if rng.random() < 0.2 else parts[8:]) for _ in range(rng.randint(0, 20))), "d", 0, i) for i in range(400)]
    rows += [(b"z" * n, "d", 0, 1000 + n) for n in (9, 10, 11)] + [(None, "d", 0, 2000), (b"q" * 10, "unknown", 0, 2001), (b"q" * 200, None, 0, 2002)]
    config = spark.createDataFrame([("d", 1.0, 4.0, 10)], CONFIG)
    got = {r.pos: (r.text, r.reason) for r in corpus.clean_records(spark.createDataFrame(rows, RAW), config).collect()}
    want = {p: clean_model(raw, 10 if d == "d" else 200) for raw, d, _, p in rows if raw is not None}
    assert got == want


def test_first_copies_keep_the_first_and_other_columns(spark):
    rows = [("a", 5, "x", 1), ("a", 2, "x", 2), ("a", 3, "y", 3), ("b", 9, "x", 4), ("a", 1, None, 5), (None, 1, "x", 6)]
    df = spark.createDataFrame(rows, "domain string, pos bigint, text string, extra int")
    got = {tuple(r) for r in corpus.first_copies(df).collect()}
    assert got == {("a", 2, "x", 2), ("a", 3, "y", 3), ("b", 9, "x", 4), (None, 1, "x", 6)}
    assert corpus.first_copies(df.limit(0)).count() == 0


def test_new_texts_and_duplicate_counts(spark):
    schema = "domain string, pos bigint, text string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "z")], schema)
    new = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("a", 4, "y"), ("b", 5, "x")], schema)
    assert {(r.domain, r.pos) for r in corpus.new_texts(new, old).collect()} == {("a", 3), ("b", 5)}
    assert {tuple(r) for r in corpus.duplicate_counts(new).collect()} == {("a", 3, 2, 1), ("b", 1, 1, 0)}


def test_running_sums_equal_a_single_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 1, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(7)
    got = {r.o: r.s for r in running_sum(df, ["g"], ["o"], "v", "s").collect()}
    want, sums = {}, {}
    for g, o, v in rows:
        want[o] = sums.get(g, 0)
        sums[g] = want[o] + (v or 0)
    assert got == want
    assert sorted(r.k for r in dense_rank(df, [], ["o"], "k").collect()) == list(range(500))
    assert running_sum(df.limit(0), ["g"], ["o"], "v", "s").count() == 0


def test_budget_and_status(spark):
    lines = spark.createDataFrame([("a", i, "x" * 10) for i in range(20)] + [("b", 0, "y" * 10)], "domain string, pos bigint, text string")
    lines = corpus.numbered(lines)
    size = lines.where("domain = 'a'").first().line_bytes
    targets = spark.createDataFrame([("a", size * 3 + 1), ("b", size * 5), ("c", 10)], "domain string, target_bytes bigint")
    kept = corpus.within_budget(lines, targets)
    assert sorted(r.pos for r in kept.where("domain = 'a'").collect()) == [0, 1, 2, 3]
    assert [r.id for r in kept.where("domain = 'b'").collect()] == ["b/000000000"]
    blocked = spark.createDataFrame([("c",)], "domain string")
    got = {r.domain: r.status for r in corpus.domain_status(kept, targets, blocked).collect()}
    assert got == {"a": "complete", "b": "partial", "c": "blocked"}


def slots_model(rows, target, n_slots):
    kept, total = [], 0
    for s in range(n_slots):
        goal = min(target, int(target / n_slots * (s + 1)))
        if total >= goal:
            continue
        for slot, pos, size in rows:
            if slot == s:
                kept.append(pos)
                total += size
                if total >= goal:
                    break
    return kept


@pytest.mark.parametrize("target", [1, 50, 117, 400, 10_000])
def test_slots_match_a_model(spark, target):
    rng = random.Random(target)
    rows = sorted((rng.choice([0, 0, 0, 1, 2]), p, rng.randint(1, 30)) for p in range(60))
    df = spark.createDataFrame([("a", s, p, n) for s, p, n in rows], "domain string, slot int, pos bigint, line_bytes bigint")
    targets = spark.createDataFrame([("a", target)], "domain string, target_bytes bigint")
    got = sorted(r.pos for r in corpus.within_slots(df, targets).collect())
    assert got == sorted(slots_model(rows, target, 3))


def test_select_domains(spark):
    df = spark.createDataFrame([("a",), ("b",)], "domain string")
    assert corpus.select_domains(df, ["a", "b"], ["b"]).count() == 1 and corpus.select_domains(df, ["a", "b"], None).count() == 2
    with pytest.raises(ValueError):
        corpus.select_domains(df, ["a"], ["x"])


def reservoir_model(n, capacity, seed):
    rng, held, written = random.Random(seed), [], []
    for t in range(n):
        if len(held) < capacity:
            held.append(t)
            continue
        j = rng.randrange(t + 1)
        if j < capacity:
            written.append(held[j])
            held[j] = t
        else:
            written.append(t)
    return held, written


@pytest.mark.parametrize("n", [0, 5, 10, 11, 300])
def test_reservoir_matches_algorithm_r(spark, n):
    import zlib

    rows = spark.range(n).select(F.col("id").alias("t"))
    got = split.reservoir(rows, "d", n, 10).collect()
    held, written = reservoir_model(n, 10, split.SEED + zlib.crc32(b"d"))
    assert {r.slot: r.t for r in got if r.resident} == dict(enumerate(held))
    # a time at which a row enters the reservoir writes the row it evicts
    assert [r.t for r in sorted((r for r in got if not r.resident), key=lambda r: r.write_order)] == written


def test_val_sizes_round_half_to_even(spark):
    ns = [0, 1, 2, 150, 201, 40_100, 40_300, 40_500, 5_000_000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select(split.val_size(F.col("n"))).collect()]
    assert got == [min(max(200, min(20_000, round(0.005 * n))), min(n, 20_000), max(0, n - 1)) for n in ns]
    assert split.val_slots("d", 1000, 1000) == sorted(set(split.val_slots("d", 1000, 1000))) and len(split.val_slots("d", 1000, 1000)) == 200


def test_hashed_split_is_exact(spark):
    rows = [("a", f"a/{i}") for i in range(900)] + [("b", "b/1")]
    got = split.hashed_val_split(spark.createDataFrame(rows, "domain string, id string")).where("split = 'val'").collect()
    ranked = sorted((hashlib.sha256(f"val:{i}".encode()).hexdigest(), i) for d, i in rows if d == "a")
    assert {r.id for r in got} == {i for _, i in ranked[:200]}


def test_segment_sample_is_the_joined_text_cut(spark):
    texts = ["alpha beta", "", "gamma" * 30, "δ" * 40, "end"]
    whole = "\n".join(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    parts = sorted(split.segment_sample(df, 60, 6, 7).collect())
    got: dict = {}
    for p in parts:
        got[p.segment] = got.get(p.segment, "") + p.part
    starts = split.segment_starts(len(whole), 60, 6, 7)
    assert got == {i: whole[s : s + 10] for i, s in enumerate(starts)}
    assert "".join(p.part for p in sorted(split.segment_sample(df, 10_000, 5, 7).collect())) == whole
    for bad in ((0, 1), (5, 0), (3, 5)):
        with pytest.raises(ValueError):
            split.segment_starts(100, *bad, 0)


def test_training_text_has_its_shares(spark):
    weights = {"b": 0.25, "a": 0.75, "c": 0.0}
    docs = {d: ["".join(d for _ in range(20 + i % 7)) for i in range(200)] for d in "ab"}
    df = spark.createDataFrame([(d, i, t) for d, v in docs.items() for i, t in enumerate(v)] + [("a", 999, None)], "domain string, pos bigint, text string")
    parts = sorted((r.domain, r.segment, r.piece, r.part) for r in split.training_text(df, weights, 400, 20, 3, oversample=2).collect())
    got = {d: "".join(p for x, *_, p in parts if x == d) for d in "ab"}
    for d, budget, segments in (("a", 300, 15), ("b", 100, 5)):
        pool, size = [], 0
        for t in docs[d]:
            if size >= budget * 2:
                break
            pool.append(t)
            size += len(t)
        whole = "\n".join(pool)
        span = budget // segments
        assert got[d] == "".join(whole[s : s + span] for s in split.segment_starts(len(whole), budget, segments, 3))
    with pytest.raises(ValueError):
        split.training_text(df, {"z": 1.0}, 400, 20, 3)


def test_epochs_are_permutations(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    a, b = ([(r.place, r.k) for r in split.epoch_rows(df, "k", 1, e).orderBy("place").collect()] for e in (0, 1))
    assert sorted(k for _, k in a) == list(range(50)) == [p for p, _ in a] and a != b
    assert [(r.place, r.k) for r in split.epoch_rows(df, "k", 1, 0, 45).orderBy("place").collect()] == a[45:]
    with pytest.raises(ValueError):
        split.epoch_rows(df, "k", 1, 0, -1)


def test_smoke_subset_falls_back_to_the_first_lines(spark):
    lines = spark.createDataFrame([("a", i, f"a/{i}", 10) for i in range(80)], "domain string, pos bigint, id string, line_bytes bigint")
    none = spark.createDataFrame([("a", 1)], "domain string, target_bytes bigint")
    assert [r.pos for r in split.smoke_subset(lines, none, 500).collect()] == [0]
    half = spark.createDataFrame([("a", 400)], "domain string, target_bytes bigint")
    assert 35 <= split.smoke_subset(lines, half, 1).count() <= 41


def test_verification_finds_each_fault(spark):
    schema = "text string, source string, id string, split string, domain string"
    good = [("t" * 200, "a", "a/1", "train", "a"), ("u" * 200, "a", "a/2", "val", "a")]
    config = spark.createDataFrame([("a", 1.0, 4.0, 200)], CONFIG)
    verdicts = lambda rows: {r.check: r.ok for r in verify.check_records(spark.createDataFrame(rows, schema), config).collect()}
    assert set(verdicts(good).values()) == {True}
    faults = {
        "C3": ("v" * 200, "b", "a/3", "train", "a"), "C4": ("v" * 200, "a", "a/1", "train", "a"), "C5": ("v" * 200, "a", "a/1", "val", "a"),
        "C6": ("v" * 200 + "\r", "a", "a/3", "train", "a"), "C7": ("v", "a", "a/3", "train", "a"), "C8": ("t" * 200, "a", "a/3", "train", "a"),
    }
    for check, row in faults.items():
        assert verdicts([*good, row])[check] is False, check
    assert verdicts([])["C4"] is True


def test_file_share_and_smoke_checks(spark):
    files = spark.createDataFrame([("a", "train_000.jsonl", 10), ("a", "val_000.jsonl", 5), ("b", "train_000.jsonl", 1)], "domain string, name string, bytes bigint")
    manifest = spark.createDataFrame([("a", 15, "complete"), ("b", 1, "complete"), ("c", 0, "blocked")], "domain string, bytes bigint, status string")
    got = {r.check: (r.ok, r.bad) for r in verify.check_files(files, manifest).collect()}
    assert got == {"C1": (False, 1), "C10": (True, 0), "C11": (True, 0)}
    sizes = spark.createDataFrame([("a", 60), ("b", 40)], "domain string, bytes bigint")
    config = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "domain string, share double")
    assert verify.check_shares(sizes, config).first().bad == 2
    assert verify.check_shares(sizes.limit(0), config).first().ok is None
    small = spark.createDataFrame([("a", 20_000_000), ("b", 20_000_000)], "domain string, bytes bigint")
    assert verify.check_smoke(sizes, small).first().ok is True and verify.check_smoke(sizes, sizes).first().ok is False
    lines = spark.createDataFrame([('{"text":"a","source":"b","id":"c"}',), ("",), ("x",), ('{"text":1}',)], "value string")
    assert tuple(verify.check_lines(lines).first())[2:] == (2, 3)


def test_sizes_equal_the_numbered_lines(spark):
    rows = [(t, d, None) for d in ("a", "b") for t in ("one text", "two texts", "one text", "thr\"ee")] + [(None, "a", r) for r in ("utf8", "too_short", "too_short", "control_char")] + [(None, "c", "utf8")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, domain string, reason string, pos bigint")
    lines = corpus.numbered(corpus.first_copies(df.where("reason is null").drop("reason")))
    want = {r.domain: r.asDict() for r in corpus.drop_tally(df, lines).collect()}
    size = {r[0]: r[1] for r in lines.groupBy("domain").agg(F.sum("line_bytes")).collect()}
    got = {r.domain: r.asDict() for r in corpus.kept_sizes(df).collect()}
    assert got == {d: {**w, "bytes": size.get(d, 0)} for d, w in want.items()}
    assert corpus.kept_sizes(df.limit(0)).count() == 0
    targets = spark.createDataFrame([("a", 10), ("b", 10_000), ("z", 5)], "domain string, target_bytes bigint")
    out = {r.domain: r for r in corpus.domain_results(corpus.kept_sizes(df), targets).collect()}
    assert (out["a"].status, out["a"].docs_val, out["a"].docs_train) == ("complete", 2, 1) and out["b"].status == out["z"].status == "partial" and out["z"].n_read == 0
    report = corpus.build_report([r.asDict() for r in out.values()])
    assert "b is " in report and "z is 5 bytes short (100.0%)" in report and "a is" not in report


def test_an_id_in_two_domains_is_split_in_each(spark):
    rows = [(d, f"{i}") for d in ("a", "b") for i in range(300)]
    got = split.hashed_val_split(spark.createDataFrame(rows, "domain string, id string"))
    assert got.count() == 600 and {(r.domain, r["n"]) for r in got.where("split = 'val'").groupBy("domain").agg(F.count("*").alias("n")).collect()} == {("a", 200), ("b", 200)}


def test_validation_pick_in_its_order(spark):
    n, held = 900, 300
    rows = spark.range(n).select(F.lit("d").alias("domain"), F.col("id").alias("t"))
    got = split.val_pick(split.reservoir(rows, "d", n, held), "d", n, held).collect()
    # a model that walks through the arrivals
    import random
    import zlib

    draws, places, train = random.Random(split.SEED + zlib.crc32(b"d")), [], []
    for t in range(n):
        j = t if t < held else draws.randrange(t + 1)
        if j >= held:
            train.append(t)
        elif t < held:
            places.append(t)
        else:
            train.append(places[j])
            places[j] = t
    drawn = split.val_slots("d", n, held)
    train += [t for s, t in enumerate(places) if s not in set(drawn)]
    by = lambda s: [r.t for r in sorted((r for r in got if r.split == s), key=lambda r: r.split_order)]
    assert by("val") == [places[s] for s in drawn] and sorted(by("train")) == sorted(train) and by("train")[-len(places) + len(drawn) :] == train[-len(places) + len(drawn) :]


def test_small_mirrors_have_a_validation_part(spark):
    rows = [(d, i, f"{d}/{i}") for d, n in (("a", 1), ("b", 2), ("c", 30)) for i in range(n)]
    got = {(r.domain, r.split): r.n for r in split.smoke_val(spark.createDataFrame(rows, "domain string, pos bigint, id string")).groupBy("domain", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "val"): 1, ("b", "val"): 1, ("b", "train"): 1, ("c", "val"): 20, ("c", "train"): 10}


def test_texts_are_not_ranged(spark, monkeypatch):
    """What running sums range and write has keys and sizes alone."""
    from millrace.operators import running

    seen = []
    whole = running.materialise
    monkeypatch.setattr(running, "materialise", lambda df, tag: seen.append(df.columns) or whole(df, tag))
    docs = spark.createDataFrame([(i, "d", "some text of a document") for i in range(50)], "pos bigint, domain string, text string")
    split.segment_sample(docs, 100, 5, 0).collect()
    split.training_text(docs, {"d": 1.0}, 100, 5, 0).collect()
    assert seen and all("text" not in c for c in seen)
