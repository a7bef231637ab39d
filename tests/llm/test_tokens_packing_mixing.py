import random

import pytest

from millrace.llm import mixing, packing, splitting, tokens
from millrace.functions.presplit import pieces

MERGES = "merge_no int, left_id int, right_id int, new_id int"


def rules(seed, n=60):
    rng = random.Random(seed)
    out, known = [], [97, 98, 99, 32, 0xE6, 0x97, 0xA5]
    for k in range(n):
        out.append((k, rng.choice(known), rng.choice(known), 256 + k))
        known.append(256 + k)
    return out


def naive(piece, rule):
    ids = list(piece.encode())
    first = {}
    for k, a, b, new in rule:
        first.setdefault((a, b), (k, new))
    while True:
        here = [first[p] for p in zip(ids, ids[1:]) if p in first]
        if not here:
            return len(ids)
        k, new = min(here)
        pair = next(p for p, v in first.items() if v[0] == k)
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_one_merge_after_the_other(spark, seed, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_SYMBOLS", 50)
    rng = random.Random(seed)
    rule = rules(seed)
    texts = ["".join(rng.choice(["a", "b", "c", "aa", "ab ", " ", "日", "日日", "\n", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", "a" * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), (0, texts[0], 0)], "k int, text string, n_tokens int")
    got = tokens.token_counts(df, spark.createDataFrame(rule, MERGES), ["k"]).collect()
    assert len(got) == len(texts) + 1
    assert {r.k: r.n_tokens for r in got} == {i: sum(naive(p, rule) for p in pieces(t)) for i, t in enumerate(texts)}


def test_no_merges_empty_tables_and_limits(spark):
    df = spark.createDataFrame([(1, "añb")], "k int, text string")
    none = spark.createDataFrame([], MERGES)
    assert tokens.token_counts(df, none, ["k"]).first().n_tokens == 4 and tokens.token_counts(df.limit(0), none, ["k"]).count() == 0
    with pytest.raises(ValueError):
        tokens.read_merges(spark.createDataFrame(rules(0), MERGES), 5)


def test_totals(spark):
    df = spark.createDataFrame([("s", "en", 3), ("s", None, 4), (None, "en", 5)], "source string, lang string, n_tokens bigint")
    got = {(r.slice, r.source, r.lang): (r.n_docs, r.n_tokens) for r in tokens.token_totals(df, ["source", "lang"]).collect()}
    assert got == {
        ("source x lang", "s", "en"): (1, 3), ("source x lang", "s", None): (1, 4), ("source x lang", None, "en"): (1, 5), ("source", "s", None): (2, 7),
        ("source", None, None): (1, 5), ("lang", None, "en"): (2, 8), ("lang", None, None): (1, 4), ("all", None, None): (3, 12),
    }


def test_differencing_keeps_all_items_and_balances():
    rng = random.Random(1)
    for k in (1, 2, 7):
        sizes = [rng.randint(1, 100) for _ in range(60)]
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(60)) and len(windows) == k
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) - min(loads) <= 20
    assert packing.differencing([], 3) == []


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_legal_and_tight(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 3, 1024, rng.randint(1, 1024), rng.randint(1, 300)]) for _ in range(rng.choice([0, 1, 5, 400]))]
    at = packing.pack(sizes)
    loads: dict = {}
    for c, s in zip(at, sizes):
        loads[c] = loads.get(c, 0) + s
    assert len(at) == len(sizes) and all(x <= 1024 for x in loads.values())
    if len(sizes) == 400:
        assert len(loads) <= 1.03 * -(-sum(sizes) // 1024) + 1


def test_packed_tables(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0, 5, 700, 1024, 1025, 5000, None]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, size int, grp string")
    got = packing.pack_items(df, "k", "size", group_items=60).collect()
    items: dict = {}
    loads: dict = {}
    for r in got:
        items.setdefault(r.item, []).append((r.part, r.start, r.size))
        loads[r.grp, r.container] = loads.get((r.grp, r.container), 0) + r.size
    assert set(items) == {k for k, s, _ in rows if s is not None} and max(loads.values()) <= 1024 and len({r.grp for r in got}) > 1
    for k, s, _ in rows:
        if s is not None:
            parts = sorted(items[k])
            assert sum(p[2] for p in parts) == s and [p[1] for p in parts] == [1024 * i for i in range(len(parts))] and len(parts) == max(1, -(-s // 1024))
    again = packing.pack_items(df.repartition(5), "k", "size", group_items=60).collect()
    assert set(map(tuple, again)) == set(map(tuple, got))
    assert packing.pack_items(df.limit(0), "k", "size").count() == 0
    report = packing.fill_report(packing.pack_items(df, "k", "size")).first()
    assert report.max_load <= 1024 and report.n_containers >= report.least_containers and 0 <= report.unused_share < 0.1


def test_mixture_reaches_its_shares(spark):
    rows = [(f"{s}/{i}", s, 50 + i % 100) for s, n in (("a", 4000), ("b", 1000), ("c", 300), ("z", 50)) for i in range(n)] + [("a/null", "a", None), ("a/0size", "a", 0), ("q/1", None, 10)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "id string, source string, n_bytes bigint, copy_no int, rate string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_to_targets(df, targets)
    uses: dict = {}
    for r in mixed.select("id", "copy_no").collect():
        uses.setdefault(r.id, []).append(r.copy_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    most = {"a": 1, "b": 2, "c": 3}
    assert all(len(v) <= most[i.split("/")[0]] for i, v in uses.items())
    assert any(len(v) == most[i.split("/")[0]] for i, v in uses.items())
    report = {r.source: r for r in mixing.mixture_report(mixed, df, targets).collect()}
    for s in most:
        assert abs(report[s].actual_share - report[s].reachable_share) < 0.02
    assert report["none"].n_used == 0 and report["none"].rate is None and report["none"].reachable_share == 0
    assert {tuple(r) for r in mixing.mix_to_targets(df.repartition(9), targets).select("id", "copy_no").collect()} == {(i, c) for i, v in uses.items() for c in v}
    assert mixing.mix_to_targets(df.limit(0), targets).count() == 0 and mixing.mix_to_targets(df, targets.limit(0)).count() == 0
    names = spark.createDataFrame([(" Web-Edu ", "x/1"), (None, "web_edu/2"), ("WEB EDU", "x/3")], "source string, id string")
    assert {r[0] for r in names.select(mixing.source_name(names.source, names.id)).collect()} == {"web_edu"}


@pytest.mark.parametrize("seed", range(4))
def test_pieces_join_to_the_text(seed):
    rng = random.Random(seed)
    for limit, overlap in ((16, 0), (40, 10), (200, 99), (2000, 200)):
        for _ in range(40):
            text = "".join(rng.choice(["word", " ", "\n", "\n\n", "End. ", "日本。", "é", "́", "😀", "‍", "\r\n", "x" * 30]) for _ in range(rng.randint(0, 120)))
            raw, pieces_ = text.encode(), splitting.cut_points(text, limit, overlap)
            assert b"".join(raw[f:e] for _, f, e, _ in pieces_) == raw
            for k, (s, f, e, _) in enumerate(pieces_):
                assert e - s <= limit and 0 <= f - s <= overlap and (k == 0 or e > f)
                raw[s:e].decode()
            assert pieces_[0][:2] == (0, 0) and pieces_[-1][3] == "end"


def test_doubling_finds_the_cuts_of_a_walk():
    """A walk from cut to cut finds the same ends: a suffix that starts at a piece is divided alike."""
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "End. ", "line\n", "日本。", "x" * 17]) for _ in range(400))
    raw, got = text.encode(), splitting.cut_points(text, 200, 0)
    at, walk = 0, []
    while at < len(raw):
        at += splitting.cut_points(raw[at:].decode(), 200, 0)[0][2]
        walk.append(at)
    assert walk == [e for *_, e, _ in got]


def test_cuts_are_at_the_best_ends():
    text = ("A sentence of some words stands here. " * 20 + "\n\n") * 12
    kinds = {k for *_, k in splitting.cut_points(text)}
    assert kinds == {"paragraph", "end"}
    assert {k for *_, k in splitting.cut_points("word " * 2000)} == {"word", "end"}
    assert {k for *_, k in splitting.cut_points("x" * 9000)} == {"character", "end"}
    assert {k for *_, k in splitting.cut_points("行く。" * 3000)} == {"sentence", "end"}
    with pytest.raises(ValueError):
        splitting.cut_points(text, 100, 50)


def test_split_tables(spark):
    long = "lorem ipsum dolor. " * 400
    df = spark.createDataFrame([(1, long, "p"), (1, long, "p"), (2, "short", "p"), (3, None, "p"), (4, "", "p"), (5, "é" * 1000, "p"), (6, "é" * 1001, "p"), (7, "z" * 2_000_000, "p")], "k int, body string, piece string")
    got = splitting.split_texts(df, ["k"], "body").collect()
    assert {r.k for r in got} == {1, 6, 7} and len([r for r in got if r.k == 1]) % 2 == 0
    assert all(len(r.piece.encode()) <= 2000 and len(r.piece.encode()) == r.end - r.start for r in got)
    assert splitting.split_texts(df.limit(0), ["k"], "body").count() == 0


def test_an_early_end_comes_before_a_cut_inside_a_word():
    text = "字" * 250 + "。" + "字" * 1000
    got = splitting.cut_points(text)
    assert got[0][2:] == (753, "sentence") and "".join(text.encode()[f:e].decode() for _, f, e, _ in got) == text
    assert [c[3] for c in got[1:-1]] == ["character"] * (len(got) - 2)


def test_an_item_of_very_many_parts_is_no_hot_group(spark):
    df = spark.createDataFrame([(0, 1024 * 30_000 + 5)] + [(i, 100 + i) for i in range(1, 40)], "doc int, n bigint")
    got = packing.pack_items(df, "doc", "n", group_items=10).collect()
    assert len(got) == 30_001 + 39 and sum(r["size"] for r in got if r.item == 0) == 1024 * 30_000 + 5
    load: dict = {}
    for r in got:
        load[r.grp, r.container] = load.get((r.grp, r.container), 0) + r["size"]
    assert max(load.values()) == 1024 and sum(c < 0 for _, c in load) == 30_000
