import random

import pytest

from millrace.llm import leakage, overlap
from millrace.llm.words import word_spans, words

SCHEMA = "id string, text string, split string, source string, fp string, text_e string, h bigint"


def shingles(text):
    ws = words(text)
    return set(zip(ws, ws[1:], ws[2:]))


def brute(rows):
    out = set()
    for i, t, s, *_ in rows:
        for j, u, r, *_ in rows:
            if None in (t, u, s, r) or s == "train" or r != "train":
                continue
            a, b = shingles(t), shingles(u)
            both = len(a & b)
            if t == u or (a | b and both >= 0.6 * len(a | b)):
                out.add((i, j))
    return out


def rows_of(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本", "ΑΣ"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60]))) for _ in range(n // 3)]
    while len(texts) < n:
        ws = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", ", ", "\n"]).join(ws))
    rows = [(f"d/{i}", t, rng.choice(["train", "train", "val", "test"]), rng.choice(["a", None]), "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[6]]  # redelivered
    return rows + [("d/n", None, "train", "a", None, None, None), ("d/m", texts[3], None, "a", None, None, None), (None, texts[3], "train", "a", None, None, None)]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.id_eval, r.id_train) for r in overlap.split_overlaps(df, ["source"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r for r in rows if r[0]])


def test_hot_copies_and_empty_tables(spark):
    hot = "the same text again and again in every second record"
    rows = [(f"t/{i}", hot, "train") for i in range(300)] + [(f"v/{i}", hot, "val") for i in range(20)] + [("v/x", "something else entirely here", "val"), ("t/e", "", "train"), ("v/e", "", "val")]
    df = spark.createDataFrame(rows, "id string, text string, split string")
    assert overlap.split_overlaps(df, []).count() == 6000 + 1
    assert overlap.split_overlaps(df.limit(0), []).count() == 0
    assert overlap.split_overlaps(df.where("split = 'train'"), []).count() == 0
    assert overlap.split_overlaps(df.where("split = 'val'"), []).count() == 0


def test_links_count_copies_without_listing_pairs(spark):
    hot = "the same text again and again in every second record of a table"
    near = hot.replace("table", "file")
    rows = [(f"t/{i}", hot, "train") for i in range(500)] + [(f"u/{i}", near, "train") for i in range(7)] + [(f"v/{i}", hot, "val") for i in range(400)]
    rows += [("w/1", near, "test"), ("w/1", near, "test"), ("w/2", "nothing like it at all", "test"), ("w/3", None, "val"), ("t/0", hot, "train")]
    df = spark.createDataFrame(rows, "id string, text string, split string")
    got = {(r.id_eval, r.split_eval): (r["class"], r.n_copies, r.n_near) for r in overlap.overlap_links(df, ["split"]).collect()}
    assert len(got) == 401 and len({c for c, *_ in got.values()}) == 2
    assert got["v/0", "val"][1:] == (500, 7) and got["w/1", "test"][1:] == (7, 500)
    assert overlap.overlap_links(df.limit(0), []).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_report_equals_the_pairs_counted(spark, seed):
    rows = [r for r in rows_of(seed) if r[0]] + [("d/5", "another text of an id", "val", "b", "x", "y", 1), ("d/x", "another text of an id", "train", "b", "x", "y", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs = overlap.split_overlaps(df, ["source", "split"]).collect()
    want = {}
    for r in pairs:
        n, ids, same = want.get((r.split_eval, r.source_eval, r.source_train), (0, set(), 0))
        want[r.split_eval, r.source_eval, r.source_train] = (n + 1, ids | {r.id_eval}, same + (r.similarity == 1))
    got = overlap.overlap_report(df, ["split", "source"], ["source"]).collect()
    assert {(r.split_eval, r.source_eval, r.source_train): (r.n_pairs, r.n_eval_records, r.n_same_words) for r in got} == {k: (n, len(i), s) for k, (n, i, s) in want.items()}
    assert len(got) == len(want) > 1 and overlap.overlap_report(df.limit(0), ["split"], []).count() == 0


def test_a_shingle_most_training_records_have(spark):
    rng = random.Random(4)
    rows = [(f"t/{i}", f"one common start {' '.join(rng.choice('abcdefgh') * 3 for _ in range(12))} {i}", "train") for i in range(3000)]
    rows += [(f"v/{i}", rows[i * 7][1] + " end", "val") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, text string, split string").repartition(4)
    got = {(r.id_eval, r.id_train) for r in overlap.split_overlaps(df, []).collect()}
    assert got == brute([(i, t, s) for i, t, s in rows[:3000:7] + rows[3000:]]) | {p for p in got if int(p[1][2:]) % 7}
    assert {(f"v/{i}", f"t/{i * 7}") for i in range(3)} <= got


def test_a_saturated_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MAX_BITS", 4)
    monkeypatch.setattr(overlap, "MIN_BITS", 4)
    monkeypatch.setattr(overlap, "_PARTS", 2)
    rows = rows_of(9, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.id_eval, r.id_train) for r in overlap.split_overlaps(df, []).collect()} == brute([r for r in rows if r[0]])


def runs_of(text, n=14):
    ws = words(text)
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}


def leaks(docs, items):
    held = {i: runs_of(t) for i, t in items if t}
    return {(d, i) for d, t in docs if t for r in [runs_of(t)] for i, h in held.items() if r & h}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(25)] + ["Ünder", "日本語", "x_y", "İstanbul", "ΟΔΟΣ"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([5, 13, 14, 15, 40])))) for i in range(30)] + [(98, None), (99, ""), (100, None)]
    docs = []
    for d in range(120):
        ws = make(rng.randint(0, 60))
        if d % 2:
            source = words(rng.choice(items[:30])[1])
            a = rng.randrange(len(source))
            ws[len(ws) // 2 :] = [w.upper() if w.isascii() else w for w in source[a : a + rng.choice([12, 13, 14, 20])]] + ws[len(ws) // 2 :]
        docs.append((d, rng.choice([" ", " - ", ".\n"]).join(ws)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(make(20_000)) + " " + items[4][1])]
    docs += [docs[1]]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaked_items(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    text = dict(docs)
    for r in got:
        assert r.n_words >= 14 and len(words(text[r.doc_id][r.start : r.end])) >= r.n_words
    # several automata give the same
    cut = leakage.leaked_items(df, it, max_item_words=50).collect()
    assert set(map(tuple, cut)) == set(map(tuple, got))
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def test_words_and_spans():
    for t in ["", "a-b_c Ünder İx ΑΣ ΑΣ.Β 日本語2", "²x½"]:
        ws, spans = word_spans(t)
        assert ws == words(t) and [t[a:b].lower() for a, b in spans] == ws
