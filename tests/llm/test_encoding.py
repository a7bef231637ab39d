import random
from collections import Counter

import pytest

from millrace.llm import encoding
from millrace.llm.encoding import CostModel, restore, round_trip

SOUND = {
    "fr": "La forêt répète enfin le bâtiment à Selve. Voilà le problème de la fenêtre, déjà célèbre après l'été. ",
    "de": "Deshalb muss man die Größe prüfen, bevor das Gemüse süß wird. Außerdem erklärt die Lösung nur das Schloss. ",
    "ru": "Потом тихий вопрос снова меняет дом. Говорят, что старый лес освещает ответ. Почему камень меняет завод? ",
    "pl": "Przykład z Kobry: każdy wie, że księżyc łączy święto i źródło. Także ogród można było kupić później. ",
    "zh": "另外，我们先检查机器，然后再观察古老的河流。很多人认为森林比数据更寒冷。 ",
    "ja": "私たちは畑を調べてから、写真を記録しました。それは新しい言葉と新しい窓の話です。 ",
    "en": "It isn’t easy to say “no” to the café – the price was £12 (about €11) and nobody knew why. ",
}
WRONG = [
    ("fr", "utf-8", "latin-1"), ("fr", "utf-8", "cp1252"), ("de", "utf-8", "cp1252"), ("pl", "utf-8", "cp1250"), ("ru", "utf-8", "cp1251"), ("zh", "utf-8", "latin-1"),
    ("ja", "utf-8", "latin-1"), ("fr", "utf-8", "cp437"), ("de", "utf-8", "mac_roman"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"),
    ("ru", "cp866", "cp1251"), ("pl", "cp1250", "cp1252"), ("zh", "gbk", "latin-1"), ("ja", "cp932", "latin-1"), ("ja", "euc_jp", "latin-1"), ("de", "cp1252", "cp437"),
]


def texts():
    rng = random.Random(0)
    out = []
    for lang, t in SOUND.items():
        ws = t.split(" ")
        for _ in range(40):
            a = rng.randrange(len(ws))
            out.append(" ".join(ws[a:] + ws[:a]))
    return out


@pytest.fixture(scope="module")
def model():
    counts: Counter = Counter()
    for t in texts():
        t = f" {t.lower()} "
        counts.update(a + b for a, b in zip(t, t[1:]))
    return CostModel.of(counts)


def misread(text, written, read):
    return encoding_bytes(text, written).decode(read, "replace") if read != "cp1252" else "".join(
        bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in encoding_bytes(text, written)
    )


def encoding_bytes(text, written):
    return text.encode(written)


@pytest.mark.parametrize("lang,written,read", WRONG)
def test_wrong_reading_is_found_and_undone(model, lang, written, read):
    sound = SOUND[lang].strip()
    for whole in (sound, SOUND["en"] + "\n\n" + sound, sound + "\n\n" + SOUND["en"].strip()):
        bad = whole.replace(sound, misread(sound, written, read))
        fixed, layers, n, _ = restore(bad, model)
        assert layers and n > 0, (lang, written, read)
        assert fixed == whole or sum(a != b for a, b in zip(fixed, whole)) < 0.1 * len(whole)


def test_nested_layers(model):
    sound = SOUND["de"].strip()
    bad = misread(misread(sound, "utf-8", "cp1252"), "utf-8", "cp1252")
    fixed, layers, *_ = restore(bad, model)
    assert fixed == sound and layers == ["cp1252>utf-8"] * 2


def test_sound_texts_are_left_alone(model):
    for t in [*SOUND.values(), *(t.upper() for t in SOUND.values()), "plain ascii", "", "• В • и – …", "&eacute;&amp;Ã", "ÀÉÎ ŠŽ", "x" * 5000 + "é"]:
        assert restore(t, model) == (t, [], 0, t), t
    quoted = "Instead of ż the page shows Å¼. Which setting of the bridge causes that?"
    assert restore(quoted, model)[1] == []
    _, layers, _, plain = restore("Instead of я the page shows Ñ\x8f. Which setting causes that?", model)
    assert layers == [] and "\x8f" not in plain


def test_round_trips():
    assert round_trip("cafÃ©", "latin-1", "utf-8") == "café" and round_trip("café", "latin-1", "utf-8") is None
    assert round_trip("日", "cp1251", "koi8-r") is None and round_trip("â€”", "cp1252", "utf-8") == "—" and round_trip("â€\x9d", "cp1252", "utf-8") == "”"


def test_tables(spark):
    good = texts()
    rows = [(i, t, "clash") for i, t in enumerate(good)] + [(900, None, None), (901, "", "x"), (902, "�lter", "x"), (903, "a\x93b", "x")]
    rows += [(904, SOUND["fr"].encode().decode("latin-1"), "x")] * 2 + [(905, "long " * 200_000 + "Ã©tÃ© dÃ©jÃ  cÃ©lÃ¨bre", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    found = encoding.garbled(df, encoding.cost_model(df)).collect()
    assert sorted(r.doc_id for r in found) == [902, 903, 904, 904, 905]
    by = {r.doc_id: r for r in found}
    assert by[904].restored == SOUND["fr"] and by[902].evidence == "replacement" and by[903].evidence == "control" and by[902].restored is None
    empty = df.limit(0)
    assert encoding.garbled(empty, encoding.cost_model(empty)).count() == 0


@pytest.mark.parametrize("lang,written,read", [("ru", "cp1251", "koi8-r"), ("ru", "cp866", "cp1251"), ("fr", "utf-8", "cp1252")])
def test_copies_do_not_make_garbled_text_usual(spark, lang, written, read):
    bad = misread(SOUND[lang].strip(), written, read)
    schema = "doc_id bigint, text string"
    good = [(i, t) for i, t in enumerate(texts())]
    once = spark.createDataFrame([*good, (1000, bad)], schema)
    often = spark.createDataFrame([*good, *((1000 + i, bad) for i in range(1500))], schema).repartition(4)
    [alone] = encoding.garbled(once, encoding.cost_model(once)).collect()
    found = encoding.garbled(often, encoding.cost_model(often)).collect()
    assert sorted(r.doc_id for r in found) == list(range(1000, 2500)) and {(r.layers, r.restored) for r in found} == {(alone.layers, alone.restored)}


@pytest.mark.parametrize("text,fixed", [("Il va Ã\xa0 Selve.", "Il va à Selve."), ("Siete Ã³ ocho casas.", "Siete ó ocho casas.")])
def test_a_single_garbled_letter_is_a_quotation_only_near_its_character(model, text, fixed):
    assert restore(text, model)[:2] == (fixed, ["cp1252>utf-8"])
    assert restore(f"It shows {text.split()[2]} instead of {fixed.split()[2]} here.", model)[1] == []


def test_more_layers_than_one_meets(model):
    sound = "Voilà le problème de la fenêtre."
    bad = sound
    for _ in range(6):
        bad = misread(bad, "utf-8", "cp1252")
    assert restore(bad, model)[:2] == (sound, ["cp1252>utf-8"] * 6)


def test_several_quotations(model):
    quoted = "Instead of ż, é and ñ the page shows Å¼, Ã© and Ã±. Why?"
    assert restore(quoted, model)[1] == [] and restore(quoted.replace("ñ", "n"), model)[1] == ["cp1252>utf-8"]


@pytest.mark.parametrize("lang,written,read", [w for w in WRONG if w[0] in ("ru", "fr", "de", "pl")])
def test_a_rare_language_is_restored_and_left_alone(lang, written, read):
    counts: Counter = Counter()
    for k, t in SOUND.items():
        for i in range(3 if k == lang else 4000):
            counts.update(a + b for a, b in zip(f" {t.lower()}", f"{t.lower()} "))
    rare = CostModel.of(counts)
    sound = SOUND[lang].strip()
    assert restore(misread(sound, written, read), rare)[0] == sound and restore(sound, rare)[1] == []


def test_pairs_beyond_the_bound(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    whole, cut = encoding.cost_model(df), encoding.cost_model(df, size=60)
    assert len(cut.costs) < len(whole.costs) and all(abs(whole.costs[p] - c) < 1e-9 for p, c in cut.costs.items())
    for p in set(whole.costs) - set(cut.costs):  # as rare pairs, not as unseen ones
        k = encoding.script(p)
        assert max(c for q, c in cut.costs.items() if encoding.script(q) == k) <= cut.pair(p) < whole.unseen[k]
