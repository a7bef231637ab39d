"""The end-of-text likelihood of problem 3: n-grams at the ends of texts against n-grams inside them.

A cut falls anywhere inside a text; a sound text ends where texts end. The score of a response is the
logarithm of (likelihood of its last symbols at an end) over (likelihood of the same symbols inside),
the sum of two n-gram models that are counted over all distinct texts:

* The text model: trigrams of symbol classes (letters, digits, a mark itself, a code fence) under the shape of
  the text so far: inside a code block, at the mark of a list entry, in an entry, in the first words, in
  the first sentence, or after it. Its ends are the ends of the responses, its own left out.
* The unit model: bigrams of words at the ends of sentences, entries and lines that are known to be whole, as
  the text goes on after them. A word's beginnings count as places inside, so a fragment of a word the texts have is
  an unlikely end. Texts of a few words without a stop are units of a model of their own too; the better
  of both holds, as "both" ends answers but hardly sentences, unless the word is known as the beginning of others alone. A stop
  is a word of the unit model as well.

Longer contexts back off to shorter ones, down to the class. The counts are tables joined on the
context, so they may be as large as they are. What a text itself adds is taken off, so no text and no
number of copies vouches for its own end.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_partition

#: Score under which an end is no end: such symbols are e^4, about 50 times, likelier inside a text.
LEAST_SCORE = -4.0
#: Weight of the shorter context in the text model, and of the class, word and pair of words in the unit model.
TEXT_WEIGHT, CLASS_WEIGHT, WORD_WEIGHT, PAIR_WEIGHT = 50.0, 1.0, 0.5, 1.0
#: Words of the first shape. Longer words than this are told apart by their hash and have no counted beginnings.
SHORT_WORDS, WORD_CHARS = 6, 64
#: Rows up to which the counts of classes are sent to every task; beyond, they are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000

#: The context of an end: shape, the last three classes (c b a), the kinds of unit, the last two words (without marks that close after a stop), what the text itself adds to the counts of the word and the pair.
CONTEXT = ("shape", "c", "b", "a", "kinds", "prev", "word", "own_ends", "own_all", "own_pair_ends", "own_pair_all")
CONTEXT_TYPES = "shape string, c string, b string, a string, kinds array<string>, prev string, word string, own_ends bigint, own_all bigint, own_pair_ends bigint, own_pair_all bigint"

_TOKEN = re.compile(r"[^\W_]+|```|\S")
_MARK = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])(?=\s|$)")
_STOPS = frozenset(".!?。！？…;；")
_KIND = {"more": "prose", "one": "prose", "short": "prose", "list": "list", "mark": "mark", "code": "code"}
_START = "^"


def _class(token: str) -> str:
    c = token[0]
    if c.isalpha():
        return "h" if c >= "⺀" else "w"
    return "0" if c.isdigit() else "F" if token == "```" else c


class _Classes(dict):
    """Classes of tokens, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        got = self[token] = _class(token)
        return got


_classes = _Classes()


def walk(text: str) -> tuple[list[str], list[str], list[bool]]:
    """The tokens of a text, the shape at each, and whether a unit is known to be whole there; words lower-cased, of scripts without blanks by character."""
    tokens: list[str] = []
    shapes: list[str] = []
    whole: list[bool] = []
    fence, sentences, n = False, 0, 0
    for line in text.split("\n"):
        mark = None if fence else _MARK.match(line)
        in_mark = len(_TOKEN.findall(mark.group())) if mark else 0
        first = len(tokens)
        for k, w in enumerate(_TOKEN.findall(line.lower())):
            if w == "```":
                fence = not fence
            if fence:
                shape = "code"
            elif mark:
                shape = "mark" if k < in_mark else "list"
            else:
                if w[0].isalnum():
                    n += 1
                shape = "more" if sentences else "short" if n <= SHORT_WORDS else "one"
            if w[0] >= "⺀" and len(w) > 1 and w[0].isalpha():
                tokens += w
                shapes += [shape] * len(w)
            else:
                tokens.append(w)
                shapes.append(shape)
            if w in _STOPS and not fence:
                sentences += 1
        if len(tokens) > first:
            sentences += 1
        whole += [False] * (len(tokens) - first)
        for i in range(first, len(tokens)):
            if shapes[i] != "mark" and tokens[i] in _STOPS:
                whole[i] = True
                if i > first and tokens[i - 1][0].isalnum():
                    whole[i - 1] = True
            elif i > first and whole[i - 1] and not tokens[i][0].isalnum() and shapes[i] != "mark":
                whole[i] = True  # a closing mark after a stop
        if len(tokens) > first:
            whole[-1] = True  # the end of a line
    return tokens, shapes, whole


def _stop(tokens: list[str], shapes: list[str]) -> int | None:
    """Where the stop stands that, with closing marks after it, ends the text."""
    i = len(tokens) - 1
    while i > 0 and not tokens[i][0].isalnum() and tokens[i] not in _STOPS and tokens[i] != "```":
        i -= 1
    return i if tokens[i] in _STOPS and shapes[-1] not in ("mark", "code") else None


def _key(token: str) -> str:
    """What a token counts as in the unit model: numbers are one word."""
    if token.isdigit():
        return "0"
    return token if len(token) <= WORD_CHARS else "#" + hashlib.md5(token.encode("utf-8", "replace")).hexdigest()


def _is_short(tokens: list[str], shapes: list[str]) -> bool:
    return bool(tokens) and shapes[-1] == "short" and _stop(tokens, shapes) is None


def _units(tokens: list[str], shapes: list[str], whole: list[bool]) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, word before, word, whole) of every place whose unit is known to be whole or not."""
    keys = [_key(t) for t in tokens]
    if _is_short(tokens, shapes):
        last = len(keys) - 1
        yield from (("short", keys[i - 1] if i else _START, k, i == last) for i, k in enumerate(keys))
        return
    before = [_START, *keys]
    for i in range(len(keys) - 1):  # what ends the text may be cut
        yield _KIND[shapes[i]], before[i], keys[i], whole[i]


def context(text: str) -> tuple | None:
    """The values of ``CONTEXT`` for the end of a text; None for a text without symbols."""
    tokens, shapes, whole = walk(text)
    if not tokens:
        return None
    classes = [_START, _START, *(_classes[t] for t in tokens[-3:])][-3:]
    last = _stop(tokens, shapes)
    last = len(tokens) - 1 if last is None else last
    word, prev = _key(tokens[last]), _key(tokens[last - 1]) if last else _START
    kinds = [_KIND[shapes[last]], *(["short"] if _is_short(tokens, shapes) else [])]
    own = [0, 0, 0, 0]
    for kind, b, w, end in _units(tokens, shapes, whole):
        if w == word and kind in kinds:
            own[0] += end
            own[1] += 1
            if b == prev:
                own[2] += end
                own[3] += 1
    return shapes[-1], *classes, kinds, prev, word, *own


def end_counts(texts: DataFrame) -> DataFrame:
    """(model, kind, c, b, a, n_ends, n_all) over (text, ends): the n-grams of both models over the distinct texts; the text model counts those with ``ends``.

    Model "text" has classes c b a under the shape ``kind``, model "unit" the word ``a`` after the word ``b`` in units of ``kind``.
    """
    columns = ("model", "kind", "c", "b", "a", "n_ends", "n_all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ends: Counter = Counter()
        total: Counter = Counter()
        for batch in batches:
            for text, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, shapes, whole = walk(text)
                if not tokens:
                    continue
                if counts:
                    classes = [_START, _START, *map(_classes.__getitem__, tokens)]
                    grams = list(zip(shapes, classes, classes[1:], classes[2:]))
                    total.update(grams)
                    ends[grams[-1]] += 1
                units = list(_units(tokens, shapes, whole))
                total.update(u[:3] for u in units)
                ends.update(u[:3] for u in units if u[3])
            if len(total) > 300_000:
                yield _rows(ends, total)
                ends.clear()
                total.clear()
        if total:
            yield _rows(ends, total)

    def _rows(ends: Counter, total: Counter) -> dict:
        rows = (("text", *g, ends[g], n) if len(g) == 4 else ("unit", g[0], "", *g[1:], ends[g], n) for g, n in total.items())
        return dict(zip(columns, zip(*rows)))

    # copies meet map-side
    distinct = texts.groupBy("text").agg(F.bool_or("ends").alias("ends"))
    parts = map_partition(distinct, run, "model string, kind string, c string, b string, a string, n_ends bigint, n_all bigint")
    return parts.groupBy("model", "kind", "c", "b", "a").agg(F.sum("n_ends").alias("n_ends"), F.sum("n_all").alias("n_all"))


def _class_of(word: Column) -> Column:
    """``_class`` of a key of the unit model; hashed words are letters."""
    return (
        F.when(F.length(word) > 32, F.lit("w")).when(word == "```", F.lit("F"))
        .when(word.rlike(r"^\p{L}"), F.when(word >= "⺀", F.lit("h")).otherwise(F.lit("w")))
        .when(word.rlike(r"^\p{Nd}"), F.lit("0")).otherwise(F.substring(word, 1, 1))
    )


def unlikely(contexts: DataFrame, counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The distinct ``contexts`` whose end scores under ``least``."""
    from ..session import materialise

    counts = materialise(counts, "p3-ends")
    contexts = materialise(contexts.withColumn("id", F.xxhash64(*CONTEXT)), "p3-contexts")
    text, unit = counts.where("model = 'text'"), counts.where("model = 'unit'")
    both = [F.sum("n_ends").alias("e"), F.sum("n_all").alias("n")]

    def level(rows: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
        out = rows.groupBy(*(c.alias(f"__{k}") for k, c in keys.items())).agg(*both)
        return out.withColumnsRenamed({"e": f"e{name}", "n": f"n{name}"})

    def joined(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{k}"))
        return left.join(right, same, "left").drop(*(f"__{k}" for k in keys)).fillna(0, [f"e{name}", f"n{name}"])

    # the text model: classes only, so its tables are small
    small = F.broadcast if text.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else lambda df: df
    scored = contexts
    for i, keys in enumerate((["a"], ["b", "a"], ["c", "b", "a"]), 1):
        names = {"shape": F.col("kind")} | {k: F.col(k) for k in keys}
        scored = joined(scored, small(level(text, names, f"t{i}")), ["shape", *keys], f"t{i}")
    totals = text.agg(F.coalesce(F.sum("n_ends"), F.lit(0)).alias("ends"), F.coalesce(F.sum("n_all"), F.lit(0)).alias("all")).first()
    n_ends, n_in = float(max(1, totals[0])), float(max(1, totals[1] - totals[0]))
    own = lambda i: F.greatest(F.col(f"et{i}") - 1, F.lit(0))
    inside = lambda i: F.col(f"nt{i}") - F.col(f"et{i}")
    ratio = ((own(1) + 0.5) / n_ends) / ((inside(1) + 5) / n_in)
    for i, first in ((2, "b"), (3, "c")):
        longer = (own(i) / n_ends + ratio * TEXT_WEIGHT / n_in) / ((inside(i) + TEXT_WEIGHT) / n_in)
        ratio = F.when(F.col(first) == _START, ratio).otherwise(longer)  # a text's first symbols have no longer context
    scored = scored.select(*contexts.columns, F.log(ratio).alias("score_text"))

    # the unit model, for each kind of unit an end may be one of
    open_ = scored.select("id", F.explode("kinds").alias("kind"), "prev", "word", "own_ends", "own_all", "own_pair_ends", "own_pair_all", _class_of(F.col("word")).alias("class"))
    unit = unit.withColumnsRenamed({"b": "prev", "a": "word"})
    words = materialise(unit.groupBy("kind", "word").agg(*both), "p3-words")
    of_class = words.withColumn("class", _class_of(F.col("word")))
    # kinds are five, and classes characters
    out = joined(open_, F.broadcast(level(words.selectExpr("kind", "e n_ends", "n n_all"), {"kind": F.col("kind")}, "0")), ["kind"], "0")
    out = joined(out, F.broadcast(level(of_class.selectExpr("kind", "class", "e n_ends", "n n_all"), {"kind": F.col("kind"), "class": F.col("class")}, "1")), ["kind", "class"], "1")
    out = joined(out, words.select(F.col("kind").alias("__kind"), F.col("word").alias("__word"), F.col("e").alias("e2"), F.col("n").alias("n2")), ["kind", "word"], "2")
    pairs = unit.select(F.col("kind").alias("__kind"), F.col("prev").alias("__prev"), F.col("word").alias("__word"), F.col("n_ends").alias("e3"), F.col("n_all").alias("n3"))
    out = joined(out, pairs, ["kind", "prev", "word"], "3")
    wanted = open_.select("kind", "word").distinct()
    longer = of_class.where((F.col("class") == "w") & (F.col("kind") != "short") & (F.length("word") > 1) & (F.length("word") <= WORD_CHARS))
    starts = longer.select("kind", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("word"))
    begun = starts.join(wanted, ["kind", "word"], "left_semi").groupBy(F.col("kind").alias("__kind"), F.col("word").alias("__word")).agg(F.lit(0).alias("e4"), F.sum("n").alias("n4"))
    out = joined(out, begun, ["kind", "word"], "4")
    less = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    p0 = (F.col("e0") + 0.5) / (F.col("n0") + 1)
    p1 = (F.col("e1") + CLASS_WEIGHT * p0) / (F.col("n1") + CLASS_WEIGHT)
    p2 = (less("e2", "own_ends") + WORD_WEIGHT * p1) / (less("n2", "own_all") + F.col("n4") + WORD_WEIGHT)
    p3 = (less("e3", "own_pair_ends") + PAIR_WEIGHT * p2) / (less("n3", "own_pair_all") + PAIR_WEIGHT)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    short = F.col("kind") == "short"
    each = out.select("id", short.alias("short"), (odds(p3) - odds(p0)).alias("s"), ((F.col("n2") == 0) & (F.col("n4") > 0)).alias("begun"), (F.col("class").isin("w", "h", "0") | (F.col("e2") > F.col("own_ends"))).alias("heard"))
    best = each.groupBy("id").agg(F.max(F.when(~F.col("short"), F.col("s"))).alias("s"), F.bool_or(~F.col("short") & F.col("begun")).alias("begun"), F.max(F.when(F.col("short") & F.col("heard"), F.col("s"))).alias("s_short"))
    units = best.select("id", F.when(F.col("begun"), F.col("s")).otherwise(F.greatest("s", "s_short")).alias("score_unit"))
    total = F.col("score_text") + F.coalesce("score_unit", F.lit(0.0))
    return scored.join(units, "id", "left").where(total < least).select(*CONTEXT)
