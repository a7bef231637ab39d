import random

import pytest

from millrace.llm import ends, pairs
from millrace.llm.langid import LanguageModel, fit_language_model
from millrace.sources.readers import MESSAGES

TEXT = {
    "en": "the school of the town opens its bridge and nobody knows why they would build another house because winter was long",
    "de": "die Schule der Stadt öffnet ihre Brücke und niemand weiß, warum sie noch ein Haus bauen, weil der Winter lang war",
    "fr": "la mairie de la ville ouvre son pont et personne ne sait pourquoi ils bâtissent une autre maison parce que l'hiver fut long",
    "es": "la escuela de la ciudad abre su puente y nadie sabe por qué construyen otra casa porque el invierno fue muy largo",
    "zh": "学校打开了桥梁，没有人知道他们为什么要再建一座房子，因为冬天很长。",
}


@pytest.fixture(scope="module")
def model():
    return LanguageModel.fit([(k, v) for k, v in TEXT.items() for _ in range(3)])


@pytest.mark.parametrize("text", [None, "", " \t\xa0", "​", "...", "…", "-", "N/A", "null", "None", "```\n```", "```python\n```", "<p></p>", '""', "[no answer]", "&nbsp;", "{{response}}", "**", "(empty)"])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["both", "72", "Empty", "none", "null pointers are the cause", "<b>yes</b>", "是", "👍", "```\nx\n```", "a" * 10_000, "[1, 2]"])
def test_not_empty(text):
    assert not pairs.is_empty(text)


QUESTION = "how do i restart an idle lexer that locks the cache?"


@pytest.mark.parametrize("text", [QUESTION, QUESTION.upper(), f"Q: {QUESTION}", f"> {QUESTION}", f'You asked: "{QUESTION}"', QUESTION[:-8]])
def test_copies(text):
    assert pairs.is_copy(text, QUESTION) and pairs.is_copy(text, f"{QUESTION}\n\nsome pasted log of many lines")


def test_no_copies():
    assert not pairs.is_copy("the lexer", QUESTION) and not pairs.is_copy(f"> {QUESTION}\n\nYou stop the cache first, then wait until it has written all and start again.", QUESTION)
    assert not pairs.is_copy("Say cheese now please", "repeat after me: Say cheese now please") and not pairs.is_copy("x", None) and not pairs.is_copy("", QUESTION)
    assert not pairs.is_copy("你好世界再见", "请原样重复：你好世界再见")


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't help with that.", "as a language model, i won't be able to provide that information. thank you for understanding.", "Sorry, no comment from me on this one.",
        "Leider kann ich dabei nicht helfen. Bitte frag etwas anderes.", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Lo siento, pero no puedo ayudarte con eso.", "很抱歉，我无法回答这个问题。请换一个问题。",
    ],
)
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize(
    "text", ["Unfortunately nobody can patch the plugin once it is stale, so start early.", "you can't widen an archive while it is open.", "sorry for the delay: the answer is 12.", "I can't recommend the first one, but the second lexer works well when the cache is full.", ""]
)
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


def test_languages_asked_for(model):
    named = lambda q: [c for c, p in pairs._NAMED.items() if p.search(q)]
    assert named("how do i polish a kiln") == named("should i polish it?") == [] and named("please answer in polish") == named("Polish, please") == ["pl"] and named("请用英语回答") == ["en"]
    assert pairs.is_other_language(TEXT["de"], "Please answer in French. why does the bridge of the town open?", model)
    assert not pairs.is_other_language(TEXT["en"], "Please answer in French. why does the bridge of the town open?", model)


def test_languages(model):
    wrong = lambda answer, question: pairs.is_other_language(answer, question, model)
    assert wrong(TEXT["de"], "why does the bridge of the town open?") and wrong(TEXT["zh"], "why does the bridge of the town open?") and wrong(TEXT["en"], "warum öffnet die Stadt ihre Brücke?")
    assert not wrong(TEXT["en"], "why does the bridge of the town open?") and not wrong(TEXT["de"], "Please answer in German. why does the bridge of the town open?")
    assert not wrong(TEXT["de"], "translate this: the bridge of the town") and not wrong("72", "why does the bridge of the town open?") and not wrong(TEXT["de"], None)
    assert not wrong(TEXT["en"], f"why does the bridge of the town open?\n\n{TEXT['de']} {TEXT['de']}") and not wrong(TEXT["en"], f"{TEXT['fr']} {TEXT['fr']}\n\nwhy does the bridge of the town open?")


def sound_talk(n, first):
    """Conversations whose answers are whole: sentences, list entries, short answers."""
    rng = random.Random(n)
    things = ["gate", "bridge", "market", "zwieback", "lantern", "village", "school", "harbour"]
    pick = lambda: rng.choice(things)
    out = []
    for i in range(n):
        sentences = " ".join(f"{rng.choice(['The', 'A', 'Then the'])} {pick()} of the {pick()} opens its {pick()} {i} times, and so does the {pick()}." for _ in range(3))
        entries = "\n".join(f"- {rng.choice(['open', 'close', 'warm'])} the {rng.choice(['red', 'blue'])} {pick()}" for _ in range(3))
        answer = sentences if i % 3 == 0 else f"{sentences}\n{entries}" if i % 3 == 1 else f"the {pick()}"
        out.append((first + i, [{"role": "user", "content": f"why is number {i} open, and which {pick()} would you close?"}, {"role": "assistant", "content": answer}]))
    return out


CUT_ENDS = [
    "The gate of the school opens. Then the", "The gate of the school opens,", "the zwieb", "The gate opens. The bridge opens its mark", "The gate opens.\n- open the red gate\n- close the", "The gate opens.\n- open the red gate\n-",
    "The gate opens.\n- open the red gate\n- warm the blue zwieb",
]
WHOLE_ENDS = ["the village", "both", "12", "The gate of the bridge opens its market.", "The gate opens.\n- open the red gate\n- warm the blue school"]


def test_ends_are_judged_by_their_likelihood(spark):
    sound = [m["content"] for _, ms in sound_talk(4000, 0) for m in ms]
    texts = spark.createDataFrame([(t, not t.startswith("why")) for t in [*sound, *CUT_ENDS, *WHOLE_ENDS] + CUT_ENDS[:1] * 50], "text string, ends boolean")
    of = {t: ends.context(t) for t in CUT_ENDS + WHOLE_ENDS}
    kind = f"t string, {ends.CONTEXT_TYPES}"
    got = ends.unlikely(spark.createDataFrame([(t, *c) for t, c in of.items()], kind).drop("t").distinct(), ends.end_counts(texts)).collect()
    found = {repr(tuple(r)) for r in got}
    assert {t for t, c in of.items() if repr(tuple(c)) in found} == set(CUT_ENDS)


def test_places_in_a_text():
    tokens, shapes, whole = ends.walk("The gate opens. Now\n1. open it\n2.\n```\nx = 1\n```\n好的。")
    assert list(zip(tokens, shapes, whole)) == [
        ("the", "short", False), ("gate", "short", False), ("opens", "short", True), (".", "short", True), ("now", "more", True),
        ("1", "mark", False), (".", "mark", False), ("open", "list", False), ("it", "list", True), ("2", "mark", False), (".", "mark", True),
        ("```", "code", True), ("x", "code", False), ("=", "code", False), ("1", "code", True), ("```", "more", True), ("好", "more", False), ("的", "more", True), ("。", "more", True),
    ]
    assert ends.context("") is None and ends.context(" \n") is None and ends.context("Done.”")[4:7] == (["prose"], "done", ".") and ends.context("x" * 1000)[6].startswith("#")
    assert ends.context("open the gate") == ("short", "w", "w", "w", ["prose", "short"], "the", "gate", 1, 1, 1, 1)


@pytest.mark.parametrize("text", [f"{QUESTION}\n{QUESTION}", f"{QUESTION} {QUESTION} {QUESTION}"])
def test_repeated_questions_are_copies(text):
    assert pairs.is_copy(text, QUESTION) and not pairs.is_copy(text + "\nYou stop the cache first, then wait until it has written all.", QUESTION)


def test_tables(spark, model):
    def talk(*said):
        return [{"role": r, "content": c} for r, c in said]

    ok = "You open the gate. Keep in mind:\n- open the red gate\n- close the blue gate"
    rows = [(i, talk(("user", f"why is gate {i} open?"), ("assistant", ok))) for i in range(30)]
    rows += [
        (100, talk(("user", QUESTION), ("assistant", None))), (101, talk(("user", QUESTION), ("assistant", QUESTION), ("assistant", "I can't help with that."))),
        (102, talk(("user", QUESTION), ("assistant", "You open the gate.\n- open the red gate\n- close the blue"))), (103, talk(("assistant", "a"), ("user", None), ("assistant", "open the gate.\nThen"))),
        (104, None), (105, []), (106, [None, {"role": None, "content": "x"}, {"role": "tool", "content": None}]), (107, talk(("user", "q"), ("assistant", "word " * 200_000 + "."))),
        (108, [{"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "f", "function": {"name": "n", "arguments": ""}}]}]),
    ]
    rows.append(rows[31])
    rows += sound_talk(4000, 1000)
    df = spark.createDataFrame([(i, m, "clash") for i, m in rows], f"conv_id bigint, messages {MESSAGES}, defect string")
    got = {tuple(r) for r in pairs.broken_pairs(df, model).collect()}
    assert got == {(100, 1, "empty"), (101, 1, "copy"), (101, 2, "refusal"), (102, 1, "truncated"), (103, 2, "truncated")}
    assert pairs.broken_pairs(df.limit(0), model).count() == 0


def test_copies_of_a_cut_end_do_not_vouch_for_it(spark, model):
    def talk(question, answer):
        return [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]

    cut = "You open the gate.\n- open the zwieb\n- close the zwieb"
    sound = sound_talk(4000, 1000)
    again = [(100, talk("why?", cut)), (100, talk("why?", cut) + talk("and then?", "Nothing.")), *((200 + i, talk(f"how about gate {i}?", cut)) for i in range(40))]
    for rows in ([(100, talk("why?", cut))], again):
        df = spark.createDataFrame(sound + rows, f"conv_id bigint, messages {MESSAGES}")
        assert {tuple(r) for r in pairs.broken_pairs(df, model).collect()} == {(i, 1, "truncated") for i, _ in rows}


def test_language_model(spark, model):
    rows = [(i, TEXT[k] + f" {i}", k.upper() if i % 5 == 0 else f"{k}-XX" if i % 7 == 0 else k) for i, k in enumerate(list(TEXT) * 12)]
    rows += [(900 + i, TEXT["de"], "fr") for i in range(2)] + [(990, None, "en"), (991, "x", None), (992, "y", "und")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fitted = fit_language_model(docs, size=8)
    assert fitted.langs == sorted(TEXT) and all(fitted.best(t) == k for k, t in TEXT.items())
    assert max(fitted.posterior(["schule", "brücke", "niemand"]), key=fitted.posterior(["schule", "brücke", "niemand"]).get) == "de"
    nothing = fit_language_model(docs.limit(0))
    assert nothing.langs == [] and nothing.best("a") is None and not pairs.is_other_language("a b c", "d e f", nothing)


def test_long_copies():
    rng = random.Random(3)
    long = [f"w{rng.randrange(300)}" for _ in range(1500)]
    text, changed = " ".join(long), " ".join(w if i % 9 else "other" for i, w in enumerate(long))
    for said in (text, changed, text.upper(), f"Q: {text}", " ".join(long[:-200])):
        assert pairs.is_copy(said, text) and pairs.is_copy(said, f"what is this?\n{text}\nthanks")
    assert not pairs.is_copy(" ".join(reversed(long)), text) and not pairs.is_copy(text, " ".join(long[:600])) and not pairs.is_copy(text, f"repeat: {text}")
    han = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(2000))
    assert pairs.is_copy(han, han) and pairs.is_copy(text * 20, text * 20)


def test_common_words_in_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert pairs._in_order(a, b) == rows[-1][-1]


@pytest.mark.parametrize("text", ["N/A" + " " * 300, "null" + "\u200b" * 300, "\u2060" * 300 + "[no answer]" + "\u3000" * 300])
def test_padded_placeholders_are_empty(text):
    assert pairs.is_empty(text) and not pairs.is_empty(text + "x" * 300)


def test_long_refusals():
    decline = ["I'm sorry, but I can't help with that. ", "Leider kann ich dabei nicht helfen. ", "很抱歉，我无法回答这个问题。", "Lo siento, pero no puedo ayudarte con eso. "]
    for d in decline:
        assert pairs.is_refusal(d * 200) and not pairs.is_refusal(d * 200 + "The answer is twelve red gates.")
    assert pairs.is_refusal("no puedo " * 50_000 + "ayudarte") and not pairs.is_refusal("no puedo " * 50_000)
