import random

import numpy as np
import pytest

from millrace.llm import quality
from millrace.llm.queries import QUERIES
from millrace.llm.langid import LanguageModel

WORDS = ["the", "of", "and", "to", "a", "in", "is", "was", "it", "that", "with", "for", "on", "as", "but", "not", "you", "or"]
NOUNS = [f"{a}{m}{b}" for a in ("bri", "ca", "dol", "fen", "gar", "mo", "ple", "sta") for m in ("", "ro", "li", "ve", "nu") for b in ("dge", "nal", "ton", "mer", "lin", "sk")]


def prose(rng, n=60):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS if i % 2 else NOUNS))
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out) + "."


def junk(rng):
    return rng.choice(
        [
            "\n".join(f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(20)),
            "\n".join(" | ".join(str(rng.randint(0, 9999)) for _ in range(5)) for _ in range(12)),
            " ".join("".join(rng.choice("xqzjvkw") for _ in range(6)) for _ in range(50)),
            "".join(rng.choice("{}[]<>#$%^&*") for _ in range(300)),
        ]
    )


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return LanguageModel.fit([("en", prose(rng)) for _ in range(20)] + [("zz", "völlig ändere wörter dörf ünd söll") for _ in range(20)])


def test_statistics_of_small_texts(model):
    common = frozenset(WORDS)
    names = ["lang", *quality.STATS]
    got = dict(zip(names, quality.statistics("The bridge, 12 of it.\n- Canal\n\nis #1!", common, model)))
    assert got["n_words"] == 8 and got["mean_word_length"] == sum(map(len, "The bridge 12 of it Canal is 1".split())) / 8
    assert got["punct_line_share"] == 2 / 3 and got["common_share"] == 4 / 8
    size = len("Thebridge,12ofit.-Canalis#1!")
    assert got["symbol_ratio"] == 1 / size and got["digit_ratio"] == 3 / size
    for t in ("", " \n", "\x00", "!!!", "12 13", "漢字漢字", "x" * 100_000):
        assert len(quality.statistics(t, common, model)) == len(names)


def test_robust_fit_and_verdicts(spark, model):
    rng = random.Random(5)
    rows = [(f"p/{i}", prose(rng, rng.randint(30, 90))) for i in range(300)] + [(f"j/{i}", junk(rng)) for i in range(60)]
    rows += [("p/upper", prose(rng).upper()), ("p/lines", prose(rng).replace(" ", "\n")), ("n", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, text string, verdict_ string")
    common = quality.common_words(df.where("text is not null"), model, "text")
    assert set(WORDS) <= common
    stats = quality.text_statistics(df, ["id"], common, model)
    got = {r.id: r for r in quality.judged(stats, quality.prose_model(stats)).collect()}
    assert set(got) == {r[0] for r in rows if r[1] is not None}
    wrong = [i for i, r in got.items() if (r.verdict == "prose") != i.startswith("p")]
    assert len(wrong) <= 3 and got["p/upper"].verdict == "prose"
    for r in list(got.values())[:50]:
        assert abs(sum(r.contributions.values()) - r.distance2) < 1e-6 * max(1, abs(r.distance2))


def test_empty_tables_and_few_rows(spark, model):
    df = spark.createDataFrame([("a", "one text only")], "id string, text string")
    for rows in (df.limit(0), df):
        stats = quality.text_statistics(rows, ["id"], frozenset(), model)
        assert quality.judged(stats, quality.prose_model(stats)).count() == rows.count()
    assert quality.common_words(df.limit(0), model, "text") == frozenset()
    blanks = spark.createDataFrame([("a", ""), ("b", " \n"), ("c", "%%%%"), ("c", "%%%%")], "id string, text string")
    stats = quality.text_statistics(blanks, ["id"], frozenset(), model)
    assert [r.verdict for r in quality.judged(stats, quality.prose_model(stats)).orderBy("id").collect()] == ["empty", "empty", "junk", "junk"]
    k = len(quality.STATS)
    unknown = quality.ProseModel({"": (np.zeros(k), np.eye(k))}).contributions(np.array(["xx", ""]), np.ones((2, k)))
    assert unknown.shape == (2, k) and (unknown.sum(axis=1) == k).all()


def test_copies_count_once(spark, tmp_path):
    rng = random.Random(9)
    # a third and more of all rows: a list of words met nowhere else
    copied = "\n".join(f"- {n}{m}x" for n, m in zip(NOUNS, NOUNS[60:] + NOUNS))
    texts = [(f"web_edu/{i}", prose(rng, rng.randint(30, 90))) for i in range(200)] + [(f"web_dclm/{i}", junk(rng)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "web_edu") for i, (_, t) in enumerate(texts[:200])], "doc_id bigint, text string, lang string, domain string")
    got = []
    for n in (1, 400):
        root = str(tmp_path / str(n))
        docs.write.parquet(f"{root}/documents.parquet")
        rows = [(i, t, "a", "train") for i, t in texts] + [(f"web_dclm/c{i}", copied, "a", "train") for i in range(n)]
        spark.createDataFrame(rows, "id string, text string, source string, split string").write.parquet(f"{root}/corpus_records.parquet")
        out = QUERIES["p2_statistics"](spark, root)
        assert "text_hash" not in out.columns
        got.append({r.id: (r.verdict, round(r.common_share, 9), round(r.distance2, 6)) for r in out.collect()})
    once, often = got
    assert len(often) == 620 and {often[i] for i in often if "/c" in i} == {once["web_dclm/c0"]} and once["web_dclm/c0"][0] != "prose"
    assert all(often[i] == v for i, v in once.items())
