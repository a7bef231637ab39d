"""Problem 3: broken prompt and response pairs.

One pass over the conversations judges every assistant message without tool calls against the nearest
user message before it. The tests, in this order, give at most one defect a message:

* ``empty``: nothing is left without white space, invisible characters, punctuation and markup, or a
  placeholder is.
* ``copy``: the words are those of the question, or of one line of the prompt, nearly all in order.
* ``refusal``: every sentence declines, is a courtesy or gives the danger as a reason, and one declines.
* ``wrong_language``: the posteriors of a character n-gram naive Bayes model differ between the
  response and the question's own words (pasted material, code and quotations left out), clearly, and
  the user doesn't ask for that language.
* ``truncated``: the end-of-text likelihood, module ``ends``: how much likelier the last symbols of the
  response are at the end of a text than at the places inside texts where a cut would fall.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches
from ..session import materialise
from . import ends
from .langid import LanguageModel
from .words import WORD, words

#: Log-likelihood lead a language needs, in the response and in the question.
LANGUAGE_LEAD = 12.0
#: A copy shares at least so much of its words with the question, and of the question's words with it.
COPY_OF_RESPONSE, COPY_OF_QUESTION = 0.75, 0.7
#: Words up to which texts are compared by matching blocks; longer ones by their longest common subsequence.
COPY_WORDS = 400
#: Occurrences from which a word's bit mask is kept.
_FREQUENT = 64

_TAG, _FENCE = re.compile(r"</?[A-Za-z!][^<>]*>"), re.compile(r"```[\w+-]*")
_PLACEHOLDER = re.compile(r"(null|nil|n/?a|nan|undefined|none|no (answer|response|reply|content|output)|not available|tbd|todo|missing|placeholder|(your |the )?(answer|response|text|content|reply)( goes)?( here)?|keine antwort|sans réponse|pas de réponse|sin respuesta|无|空|无回答|没有回答|暂无)")
_WRAPPED = re.compile(r"[\[{(<]+[^\[\]{}()<>]{0,40}[\]})>]+")
_REPEAT = re.compile(r"\b(repeat|echo|say (exactly|after|back)|copy|verbatim|unchanged|word for word|quote|wiederhol\w*|sprich nach|nachsprechen|wörtlich|unverändert|répèt\w*|redis|recopi\w*|mot pour mot|repit\w*|repet\w*|copia\w*|palabra por palabra|textualmente)\b|重复|复述|照抄|原样|跟我念|跟我说", re.I)
#: Names of languages, by code: those of alphabets, matched as words, and those of scripts without blanks.
_NAMES = {
    "en": (r"english|englisch\w*|anglais\w*|inglés", "英语|英文"),
    "de": (r"german|deutsch\w*|allemand\w*|alemán", "德语|德文"),
    "fr": (r"french|französisch\w*|français\w*|francés", "法语|法文"),
    "es": (r"spanish|spanisch\w*|espagnol\w*|español", "西班牙语|西班牙文"),
    "zh": (r"chinese|mandarin|chinesisch\w*|chinois\w*|chino", "中文|汉语"),
    "ru": (r"russian|russisch\w*|russe|ruso|по-русски", "俄语|俄文"),
    # the verb "polish" is no language
    "pl": (r"(?-i:Polish)|in(?:to)? polish(?! (?:an?|the|my|it)\b)|polnisch\w*|polonais\w*|polaco", "波兰语|波兰文"),
    "pt": (r"portuguese|portugiesisch\w*|portugais\w*|portugués", "葡萄牙语|葡萄牙文"),
    "ja": (r"japanese|japanisch\w*|japonais\w*|japonés", "日语|日文"),
}
_NAMED = {code: re.compile(rf"\b(?:{latin})\b|{cjk}", re.I) for code, (latin, cjk) in _NAMES.items()}
_TRANSLATE = re.compile(r"\b(translat\w*|übersetz\w*|tradui\w*|traduc\w*)\b|翻译", re.I)
_QUOTED = re.compile(r"```.*?(```|$)|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|「[^」\n]*」", re.S)
_SENTENCE = re.compile(r"(?<=[.!?;。！？；…])\s*|\n+")

_DECLINE = re.compile(
    r"\b(i|we)\b[^.!?]{0,25}\b(can['’]?t|cannot|can not|could not|won['’]?t|will not|must|have to|am not|are not|['’]m not|unable|refuse|decline|['’]d rather|would rather|shouldn['’]?t|do not|don['’]?t)\b[^.!?]{0,40}\b(help|assist|answer|provide|discuss|respond|comply|share|talk|go into|refuse|decline|support|engage|continue|do that|say|comment|fulfil\w*|complete)\b"
    r"|\bi (must|have to|will) (refuse|decline)|\bi (refuse|decline)\b|against (my|our) (guidelines|policy|policies|rules|principles)|\bno comment\b|not something (i|we) (can|talk|discuss|do)\b|\bcan['’]?t (help|assist) (you )?with (that|this)|not able to (help|assist|answer)|unable to (help|assist|answer|comply)"
    r"|\b(muss|möchte|werde) ich\b[^.!?]*\b(ablehnen|verweigern)|ich (muss|möchte)\b[^.!?]*\b(ablehnen|verweigern)|\b(kann|darf|möchte|werde) ich\b[^.!?]*\bnicht\b[^.!?]*\b(helfen|beantworten|antworten|geben|sagen|unterstützen|eingehen)|ich (kann|darf|möchte|werde)\b[^.!?]*\bnicht\b[^.!?]*\b(helfen|beantworten|antworten|geben|sagen|unterstützen|eingehen)|nicht in der lage|gegen meine (richtlinien|regeln)"
    r"|je (ne )?(peux|puis|suis|dois|préfère|refuse)\b[^.!?]*\b(pas|refuser|décliner|refuse)\b|je (refuse|décline)\b|contraire à mes (règles|principes)"
    r"|no (puedo|podemos|podré|estoy|me es posible|quiero|debo)\b[^.!?]*\b(ayudar\w*|responder\w*|contestar\w*|proporcionar\w*|hablar|autorizad\w|dar\w*)|\b(debo|tengo que|prefiero)\b[^.!?]*\b(rechazar\w*|negar\w*|declinar\w*|no (responder|contestar|hablar))|en contra de mis (normas|reglas)"
    r"|我?(无法|不能|不便|不可以|拒绝|必须拒绝|没办法|不会)[^。！？]*(回答|帮助|帮忙|提供|协助|回应|请求|讨论|问题)",
    re.I,
)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside all brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


#: Each alternative, cut at its open gaps.
_DECLINE_PARTS = [[re.compile(p, re.I) for p in re.split(r"\[\^[.!?。！？]+\]\*", a)] for a in _alternatives(_DECLINE.pattern)]
_COURTESY = re.compile(
    r"^\W*(sorry|i['’]?m (very |so |really )?sorry|i apologi[sz]e|apologies|unfortunately|thank you|thanks|please|is there anything|as an? (ai|language model)|(it|this|that|doing so) (could|might|may|would) (lead|cause|be)|let['’]s (change|talk)|feel free|perhaps|maybe|i hope you understand"
    r"|leider|es tut mir leid|tut mir leid|entschuldig\w*|verzeihung|bitte|danke|vielen dank|kann ich (dir|ihnen) sonst|gibt es sonst|(désolé|navré)\w*|je suis (désolé|navré)\w*|malheureusement|merci|pardon|excusez|puis-je|posez|demande\w*|y a-t-il|veuillez"
    r"|lo siento|lo lamento|perdon\w*|perdón|lamentablemente|disculp\w*|gracias|por favor|¿?quieres|¿?quiere|¿?hay (algo|otra)|¿?puedo|很抱歉|抱歉|对不起|不好意思|请|谢谢|感谢|还有)",
    re.I,
)


def is_empty(text: str | None) -> bool:
    """Null, or nothing but white space, invisible characters, punctuation, empty markup or a placeholder."""
    if text is None:
        return True
    bare = _FENCE.sub("", _TAG.sub("", html.unescape(text)))
    if not WORD.search(bare) and not any(unicodedata.category(c)[0] not in "PZC" and not c.isascii() for c in bare):
        return True
    a, b = 0, len(bare)
    while a < b and _pads(bare[a]):
        a += 1
    while a < b and _pads(bare[b - 1]):
        b -= 1
    if b - a > 200:
        return False
    plain = bare[a:b]
    if _WRAPPED.fullmatch(plain):
        inner = plain.strip("[]{}()<> \"'").lower()
        return bool(_PLACEHOLDER.fullmatch(inner) or inner in ("empty", "blank", "..."))
    return plain != "none" and len(plain) <= 40 and bool(_PLACEHOLDER.fullmatch(plain.lower()))


def _pads(c: str) -> bool:
    """White space, invisible characters and marks around a placeholder."""
    return c in "\"'`*_." or c.isspace() or unicodedata.category(c)[0] in "ZC"


def _units(text: str) -> list[str]:
    """Words, or single characters of scripts without blanks."""
    out: list[str] = []
    for w in words(text):
        out += list(w) if w[0] >= "⺀" else [w]
    return out


def is_copy(response: str, prompt: str | None) -> bool:
    """The question again, once or repeatedly, or one line of the prompt, unless a repetition is asked for."""
    if not prompt or _REPEAT.search(prompt):
        return False
    said = _units(response)
    if not said:
        return False
    seen = set(said)
    for line in [prompt, *(p for p in re.split(r"\n+", prompt) if p != prompt)]:
        asked = _units(line)
        if len(asked) < 3 or len(seen & set(asked)) < COPY_OF_QUESTION * len(set(asked)):
            continue
        if _alike(said, asked):
            return True
        # the question several times over: as many equal parts, each alike
        times = round(len(said) / len(asked))
        if times > 1 and abs(len(said) - times * len(asked)) <= len(asked) // 4:
            step = len(said) / times
            if all(_alike(said[round(i * step) : round((i + 1) * step)], asked) for i in range(times)):
                return True
    return False


def _alike(said: list[str], asked: list[str]) -> bool:
    """Whether nearly all words agree in order."""
    if len(said) > 1.6 * len(asked) + 2 or len(said) < COPY_OF_QUESTION * len(asked):
        return False
    least = max(COPY_OF_RESPONSE * len(said), COPY_OF_QUESTION * len(asked))
    if (Counter(said) & Counter(asked)).total() < least:
        return False
    if max(len(said), len(asked)) <= COPY_WORDS:
        same = sum(b.size for b in SequenceMatcher(None, said, asked, False).get_matching_blocks())
    else:
        same = _in_order(said, asked)
    return same >= least


def _in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: linear where the ends agree, between them a row of bits a word."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)

    def mask(places: list[int]) -> int:
        bits = bytearray(len(a) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    kept = {w: mask(places) for w, places in at.items() if len(places) > _FREQUENT}
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if w in at:
            hit = row & (kept[w] if w in kept else mask(at[w]))
            row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def is_refusal(response: str) -> bool:
    """Declines and gives no answer."""
    other, declines = 0, False
    for s in _SENTENCE.split(response):
        if s and _declines(s):
            declines = True
        elif s and not _COURTESY.search(s):
            other += len(_units(s))
            if other > 3:
                return False
    return declines or _declines(response)


def _declines(text: str) -> bool:
    """Whether ``_DECLINE`` is found; in long texts part by part, as its open gaps would take quadratic time."""
    if len(text) <= 1500:
        return bool(_DECLINE.search(text))
    for stretch in re.split(r"(?<=[.!?。！？])", text):
        for parts in _DECLINE_PARTS:
            end = 0
            for part in parts:
                m = part.search(stretch, end)
                if m is None:
                    break
                end = m.end()
            else:
                return True
    return False


def question_of(prompt: str) -> str:
    """The question's own words: without code and quotations, and of several paragraphs the asking one."""
    parts = [p for p in re.split(r"\n\s*\n", prompt) if p.strip()]
    if len(parts) > 1:
        ends = [parts[0], parts[-1]]
        asking = [p for p in ends if p.rstrip().endswith(("?", "？"))] or ends
        asking = [p for p in asking if len(_units(p)) <= 60] or asking
        prompt = min(asking, key=len)
    return _QUOTED.sub(" ", prompt)


def is_other_language(response: str, prompt: str | None, model: LanguageModel) -> bool:
    """In another language than the question, clearly, and none was asked for."""
    if not prompt:
        return False
    asked, said = question_of(prompt), _QUOTED.sub(" ", response)
    found = []
    for text in (asked, said):
        ws = [w for w in words(text) if not w.isdigit()]
        if not ws or len(model.langs) < 2 or (len(ws) < 3 and ws[0][0] < "⺀"):
            return False
        s = model.scores(ws)
        second, first = sorted(s)[-2:]
        if first - second < LANGUAGE_LEAD:
            return False
        found.append(model.langs[int(s.argmax())])
    if found[0] == found[1]:
        return False
    named = [code for code, pattern in _NAMED.items() if pattern.search(asked)]
    # a translation may go to a language that isn't named by one of these words
    return found[1] not in named and not (_TRANSLATE.search(asked) and not set(named) & set(model.langs))


def judged(conversations: DataFrame, model: LanguageModel, conv_id: str = "conv_id", column: str = "messages") -> DataFrame:
    """(conv_id, msg_idx, defect, <columns of ends.CONTEXT>): the verdict on each assistant message, or the context of its end."""
    shared = conversations.sparkSession.sparkContext.broadcast(model)
    kind = conversations.schema[conv_id].dataType.simpleString()
    source = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.transform(column, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), (F.coalesce(F.size(m.tool_calls), F.lit(0)) > 0).alias("calls"))).alias("m"),
    ).where("m is not null").distinct()
    names = ("conv_id", "msg_idx", "defect", *ends.CONTEXT)

    def run(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for cid, msgs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            prompt = None
            for i, m in enumerate(msgs):
                if m is None:
                    continue
                if m["role"] == "user":
                    prompt = m["content"]
                elif m["role"] == "assistant" and not m["calls"]:
                    defect = _defect(m["content"], prompt, shared.value)
                    context = None if defect else ends.context(m["content"])
                    rows.append((cid, i, defect, *(context or (None,) * len(ends.CONTEXT))))
        return dict(zip(names, zip(*rows))) if rows else None

    return map_batches(source, run, f"conv_id {kind}, msg_idx int, defect string, {ends.CONTEXT_TYPES}")


def _defect(text: str | None, prompt: str | None, model: LanguageModel) -> str | None:
    """The defect that shows without the likelihood of the end."""
    return (
        "empty" if is_empty(text)
        else "copy" if is_copy(text, prompt)
        else "refusal" if is_refusal(text)
        else "wrong_language" if is_other_language(text, prompt, model)
        else None
    )


def broken_pairs(conversations: DataFrame, model: LanguageModel, conv_id: str = "conv_id", column: str = "messages") -> DataFrame:
    """(conv_id, msg_idx, defect) of every defective assistant message; redelivered conversations count once.

    Null message lists and null messages are skipped, a missing or null prompt is compared with nothing,
    null content is empty. Messages of other roles and with tool calls are never judged.
    """
    # written, as the likelihood reads the contexts and the verdicts
    verdicts = materialise(judged(conversations, model, conv_id, column), "p3-verdicts")
    sure = verdicts.where("defect is not null").select("conv_id", "msg_idx", "defect")
    said = conversations.select(F.explode(F.col(column)).alias("m")).where("m.role in ('assistant', 'user') and m.content is not null")
    texts = said.select(F.col("m.content").alias("text"), ((F.col("m.role") == "assistant") & (F.coalesce(F.size("m.tool_calls"), F.lit(0)) < 1)).alias("ends"))
    open_ = verdicts.where("defect is null and shape is not null")
    cut = ends.unlikely(open_.select(*ends.CONTEXT).distinct(), ends.end_counts(texts))
    found = open_.join(cut, list(ends.CONTEXT)).select("conv_id", "msg_idx", F.lit("truncated").alias("defect"))
    return sure.unionByName(found).distinct()
