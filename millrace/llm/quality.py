"""Problem 2: per-document text quality statistics and a verdict by robust Mahalanobis distance.

Two passes read the texts. The first counts, for every language, in how many distinct texts a word occurs;
the most frequent ones are the common words. The second computes the statistics, a narrow table that is
written once. Mean and covariance of prose are then estimated for every language over all distinct texts
of the prose domains, so that no number of copies makes a text the norm:

* Statistics that are shares or counts are put on a scale on which prose is about normal (``STATS``).
* Only plausible texts take part: those within ``PLAUSIBLE`` of the medians and spreads of all texts, whatever their language, in the
  statistics that mean the same in every language. So a language that noise is taken for doesn't learn the noise, even if it is half of its texts.
* The start is each language's medians with the spread of all; then, a few times, the part ``CORE`` of each language's plausible texts nearest to
  the last fit gives the next one (concentration steps).
* A language's covariance is shrunk towards that of all languages, the more the fewer texts it has; languages with hardly
  any take mean and covariance of all.

Nothing bounds a deviation: how far each statistic may stray, and with which others, is learned. The threshold is
learned too: the logarithms of squared distances are about normal, and what lies ``CUT`` robust deviations
above the median of the plausible texts isn't natural prose. The statistics' contributions add up to the squared distance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches, map_partition
from ..session import materialise
from .langid import LanguageModel
from .words import words

#: The statistics, and the scale each is judged on.
STATS = {
    "n_words": np.log1p,
    "mean_word_length": np.log1p,
    "symbol_ratio": np.sqrt,
    "digit_ratio": np.sqrt,
    "punct_line_share": lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1))),
    "common_share": lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1))),
    "common_variety": np.log1p,
    "separator_rate": np.log1p,
    "repetition": np.sqrt,
    "strangeness": np.log1p,
}
#: Common words per language, and the least share of a language's documents that have such a word.
COMMON_WORDS, COMMON_SHARE = 50, 0.02
#: Robust standard deviations of the log squared distance above its median from which a text isn't natural prose (about one normal value in 100,000).
CUT = 4.25
#: The statistics a text is plausible by, and the squared distance: of six normal values one in a million is beyond it.
COMMON, PLAUSIBLE = ("symbol_ratio", "digit_ratio", "separator_rate", "strangeness", "punct_line_share", "repetition"), 38.26
#: Share of a language's plausible texts nearest to the fit that give the next one, and how often.
CORE, STEPS = 0.95, 3
#: Documents a language's covariance must have to count as much as that of all languages, and for a mean of its own.
SHRINK_DOCS, OWN_DOCS = 100, 20
#: Least variance of a statistic, for those (nearly) constant in prose: this part of the sampling variance 1/(4 n) of a share of n words or characters on its scale.
SAMPLING, _LEAST_VARIANCE = 0.25, 1e-8
_SHARES = {"symbol_ratio": "chars", "digit_ratio": "chars", "common_share": "words", "separator_rate": "words", "repetition": "words"}
PROSE_DOMAINS = ("web_edu", "web_dclm", "cosmopedia", "qa_stackexchange")

_END = re.compile(r"[.!?。！？…:;：；]+[\"'”’»)\]*_`」』]*$")
_SOFT = frozenset(".,;:!?'\"()-–—…’‘“”„«»¿¡。，、！？；：（）「」『』《》·")
_CJK = re.compile("[⺀-\U0003ffff]")
_SEPARATOR = re.compile(r"[,;|/\\=:、，]|\t| {2,}|\.{3,}|-{2,}|(?m:^\s*(?:[-*•+]|\d+[.)])\s)|(?m:[^.!?。！？…\s]\s*$)")


def units(ws: list[str]) -> list[str]:
    """Words; of scripts without blanks pairs of neighbouring characters."""
    out: list[str] = []
    for w in ws:
        if w[0] < "⺀":
            out.append(w)
        elif len(w) < 3:
            out.append(w)
        else:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
    return out


def statistics(text: str, common: frozenset[str], model: LanguageModel) -> tuple:
    """(language, then the values of STATS)."""
    ws = words(text)
    dense = _CJK.search(text) is not None  # has scripts without blanks
    us = units(ws) if dense else ws
    n = len(us)
    solid = "".join(text.split())
    size = max(1, len(solid))
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    letters = digits = soft = 0
    for c, k in Counter(solid).items():
        if c.isalpha():
            letters += k
        elif c.isdigit():
            digits += k
        elif c in _SOFT or not c.isprintable():
            soft += k
    plain = [w for w in ws if not w.isdigit()]
    scores, likeliest = model.scores_and_likeliest(plain)
    best = int(np.argmax(scores)) if len(scores) and plain else -1
    n_grams = sum(2 * len(w) - 1 if w[0] >= "⺀" else 4 * len(w) + 2 for w in plain) if dense else 4 * len("".join(plain)) + 2 * len(plain)
    hits = list(filter(common.__contains__, us))
    threes = set(zip(us, us[1:], us[2:]))
    return (
        model.langs[best] if best >= 0 else None,
        len(ws),
        len("".join(ws)) / max(1, len(ws)),
        (len(solid) - letters - digits - soft) / size,
        digits / size,
        sum(map(bool, map(_END.search, lines))) / max(1, len(lines)),
        len(hits) / max(1, n),
        len(set(hits)) / math.sqrt(max(1, n)),
        len(_SEPARATOR.findall(text)) / max(1, n),
        1 - len(threes) / max(1, n - 2) if threes else 0.0,
        -likeliest / max(1, n_grams) if best >= 0 else 12.0,
    )


def common_words(docs: DataFrame, model: LanguageModel, text: str) -> frozenset[str]:
    """The common words of all languages: each one's most frequent by documents, counted over all documents, copies once.

    At most ``COMMON_WORDS`` a language come to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: dict[str, Counter] = {}
        size: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ws = words(t)
                lang = model_best(shared.value, ws)
                if lang is not None:
                    size[lang] += 1
                    seen.setdefault(lang, Counter()).update({u for u in (units(ws) if _CJK.search(t) else ws) if not u.isdigit()})
            if sum(map(len, seen.values())) > 200_000:
                yield _flat(seen, size)
                seen, size = {}, Counter()
        if seen:
            yield _flat(seen, size)

    counted = map_partition(docs.where(F.col(text).isNotNull()).select(text).distinct(), count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.where("n > 1 or word = ''"), "p2-words")
    sizes = {r[0]: r[1] for r in counted.where("word = ''").select("lang", "n").collect()}
    out: set[str] = set()
    for lang, n in sizes.items():
        own = counted.where((F.col("lang") == lang) & (F.col("word") != "") & (F.col("n") >= max(2, COMMON_SHARE * n)))
        out |= {r[0] for r in own.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").collect()}
    return frozenset(out)


def model_best(model: LanguageModel, ws: list[str]) -> str | None:
    plain = [w for w in ws if not w.isdigit()]
    return model.langs[int(np.argmax(model.scores(plain)))] if plain and model.langs else None


def _flat(seen: dict[str, Counter], size: Counter) -> dict:
    rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()] + [(lang, "", n) for lang, n in size.items()]
    return dict(zip(("lang", "word", "n"), zip(*rows)))


def text_statistics(docs: DataFrame, keep: list[str], common: frozenset[str], model: LanguageModel, text: str = "text") -> DataFrame:
    """The columns ``keep``, lang and the statistics of every non-null text; strangeness is the mean cost of an n-gram, each word in its likeliest language.

    Without words there is no language, and what has nothing to be computed from is 0; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, model))
    names = ["lang", *STATS]
    kinds = ["string", "bigint", *["double"] * (len(STATS) - 1)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {k}" for n, k in zip(names, kinds)])

    def run(batch: pa.RecordBatch) -> dict:
        rows = [statistics(t, *shared.value) for t in batch.column(0).to_pylist()]
        return {c: batch.column(i + 1) for i, c in enumerate(keep)} | dict(zip(names, zip(*rows)))

    return map_batches(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text"), *keep), run, schema)


def scaled(columns: list[np.ndarray]) -> np.ndarray:
    """The statistics, in the order of ``STATS``, on their scales: a row a text."""
    return np.column_stack([f(np.asarray(c, float)) for f, c in zip(STATS.values(), columns)])


class ProseModel:
    """Mean and inverse covariance of prose per language ("" for languages without an own one), and the threshold of the squared distance."""

    def __init__(self, by_lang: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float = math.inf) -> None:
        self.by_lang, self.threshold = by_lang, threshold

    def contributions(self, langs: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each statistic's part of the squared distance of each row; a row's sum is never negative."""
        out = np.zeros(x.shape)
        if self.by_lang:
            for lang in set(langs.tolist()):
                own = langs == lang
                mean, inverse = self.by_lang.get(lang, self.by_lang[""])
                z = x[own] - mean
                out[own] = z * (z @ inverse)
        return out


def _least_variances(middle: np.ndarray) -> np.ndarray:
    """The least variance of each statistic, for texts of the length of ``middle``, the medians on their scales."""
    words, length = (max(1.0, float(np.expm1(middle[i]))) for i in range(2))
    n = {"words": words, "chars": words * length}
    return np.array([SAMPLING / (4 * n[_SHARES[c]]) if c in _SHARES else _LEAST_VARIANCE for c in STATS])


def prose_model(stats: DataFrame, text_key: str | None = None) -> ProseModel:
    """The robust fit over all rows of ``stats`` with words; languages x statistics squared numbers come to the driver.

    Rows that agree in ``text_key``, a hash of the text, count once. With fewer than ``OWN_DOCS`` rows there is no
    fit: all distances are 0 and the threshold infinite.
    """
    names = list(STATS)
    key = [text_key] if text_key is not None else []
    kinds = ", ".join(["lang string", *(f"`{n}` double" for n in names)])

    def scale(batch: pa.RecordBatch) -> dict:
        x = scaled([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
        return {"lang": batch.column(0)} | dict(zip(names, x.T))

    rows = stats.where("lang is not null").select(*key, "lang", *names)
    # copies meet map-side; all statistics follow from the text
    rows = materialise(map_batches((rows.distinct() if key else rows).select("lang", *names), scale, kinds), "p2-scaled")
    rows = _plausible(rows)
    middles = rows.groupBy("lang").agg(F.count("*").alias("n"), *(F.percentile_approx(n, 0.5, 1000).alias(n) for n in names)).collect()
    if sum(r["n"] for r in middles) < OWN_DOCS:
        return ProseModel({})
    means = {r["lang"]: np.array([r[n] for n in names], float) for r in middles}
    whole = sum(r["n"] * means[r["lang"]] for r in middles) / sum(r["n"] for r in middles)
    centre = {r["lang"]: means[r["lang"]] if r["n"] >= OWN_DOCS else whole for r in middles}
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def deviations(batch: pa.RecordBatch) -> dict:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
        off = np.abs(x - np.array([shared.value[lang] for lang in batch.column(0).to_pylist()]))
        return {"lang": batch.column(0)} | dict(zip(names, off.T))

    at = map_batches(rows, deviations, kinds).agg(*(F.percentile_approx(n, [0.5, 0.85], 1000).alias(n) for n in names)).first()
    spread = np.array([max(at[n][0] / 0.674, at[n][1] / 1.44) for n in names])
    least = {lang: _least_variances(m) for lang, m in centre.items()} | {"": _least_variances(whole)}
    start = {lang: np.diag(1 / np.maximum(spread**2, v)) for lang, v in least.items()}
    model = ProseModel({lang: (mean, start[lang]) for lang, mean in (centre | {"": whole}).items()})
    for _ in range(STEPS):
        cuts = {r[0]: r[1] for r in distances(rows, model).groupBy("lang").agg(F.percentile_approx("d", CORE, 1000)).collect()}
        model = _estimate(_moments(rows, model, cuts), model, least)
    low, mid, high = distances(rows, model).agg(F.percentile_approx(F.log(F.col("d") + 1e-9), [0.25, 0.5, 0.75], 1000)).first()[0]
    model.threshold = math.exp(mid + CUT * max(high - low, 0.1) / 1.349)  # a normal distribution's middle half is 1.349 deviations wide
    return model


def distances(rows: DataFrame, model: ProseModel) -> DataFrame:
    """(lang, d): the squared distance of each row (lang, <scaled statistics>)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
        return {"lang": batch.column(0), "d": shared.value.contributions(np.array(batch.column(0).to_pylist()), x).sum(axis=1)}

    return map_batches(rows, run, "lang string, d double")


def _plausible(rows: DataFrame) -> DataFrame:
    """The rows near the medians of all in the statistics that mean the same in every language."""
    middle = rows.agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in COMMON)).first()
    if middle[0] is None:
        return rows
    off = {c: F.abs(F.col(c) - F.lit(float(middle[c]))) for c in COMMON}
    at = rows.agg(*(F.percentile_approx(off[c], [0.5, 0.85], 1000).alias(c) for c in COMMON)).first()
    # a normal value is within 0.674 deviations half the time, and within 1.44 in 85 of 100 cases
    spread = {c: max(at[c][0] / 0.674, at[c][1] / 1.44, 1e-3) for c in COMMON}
    total = F.lit(0.0)
    for c in COMMON:
        total = total + F.pow(off[c] / F.lit(spread[c]), F.lit(2.0))
    return rows.where(total <= PLAUSIBLE)


def _moments(rows: DataFrame, model: ProseModel, cuts: dict[str, float]) -> dict[str, np.ndarray]:
    """Per language the sums of 1, x and x x' over the texts within its cut of ``model``, flattened."""
    shared = rows.sparkSession.sparkContext.broadcast((model, cuts))
    k = len(STATS)

    def part(batch: pa.RecordBatch) -> dict | None:
        langs = np.array(batch.column(0).to_pylist())
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
        model, cuts = shared.value
        good = model.contributions(langs, x).sum(axis=1) <= np.array([cuts[lang] for lang in langs.tolist()])
        out = []
        for lang in set(langs.tolist()):
            own = x[good & (langs == lang)]
            flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            out += [(lang, i, v) for i, v in enumerate(flat.tolist())]
        return dict(zip(("lang", "i", "v"), zip(*out))) if out else None

    total = map_batches(rows, part, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    sums: dict[str, np.ndarray] = {}
    for r in total.collect():
        sums.setdefault(r[0], np.zeros(1 + k + k * k))[r[1]] = r[2]
    return sums


def _estimate(sums: dict[str, np.ndarray], last: ProseModel, least: dict[str, np.ndarray]) -> ProseModel:
    """Means and inverse covariances of the sums; a language without enough texts takes those of all."""
    k = len(STATS)

    def fit(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = s[1 : 1 + k] / s[0]
        return s[0], mean, s[1 + k :].reshape(k, k) / s[0] - np.outer(mean, mean)

    parts = {lang: fit(s) for lang, s in sums.items() if s[0] >= OWN_DOCS}
    if not parts:
        return last
    within = sum(n * cov for n, _, cov in parts.values()) / sum(n for n, _, _ in parts.values())
    _, mean, cov = fit(sum(s for s in sums.values()))
    out = {"": (mean, _inverse(cov, least[""]))}
    for lang, (n, own, cov) in parts.items():
        out[lang] = (own, _inverse((n * cov + SHRINK_DOCS * within) / (n + SHRINK_DOCS), least[lang]))
    return ProseModel(out)


def _inverse(cov: np.ndarray, least: np.ndarray) -> np.ndarray:
    own = np.diag(cov)
    return np.linalg.inv(cov + np.diag(np.maximum(least - own, 1e-6 * own)))


def judged(stats: DataFrame, model: ProseModel) -> DataFrame:
    """``stats`` with distance2, contributions (a map by statistic) and verdict: prose, junk (a list, table or junk), or empty for a text without anything to judge.

    What has symbols but no word is junk.
    """
    shared = stats.sparkSession.sparkContext.broadcast(model)
    names = list(STATS)

    def run(batch: pa.RecordBatch) -> dict:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        x = scaled([batch.column(at[c]).to_numpy(zero_copy_only=False) for c in names])
        langs = np.array([lang or "" for lang in batch.column(at["lang"]).to_pylist()])
        each = shared.value.contributions(langs, x)
        maps = pa.MapArray.from_arrays(np.arange(len(x) + 1) * len(names), pa.array(names * len(x), pa.string()), pa.array(each.ravel(), pa.float64()))
        return {n: batch.column(i) for n, i in at.items()} | {"distance2": each.sum(axis=1), "contributions": maps}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", distance2 double, contributions map<string,double>"
    return map_batches(stats, run, schema).withColumn("verdict", _verdict(model.threshold))


def _verdict(threshold: float) -> Column:
    blank = (F.col("n_words") == 0) & (F.col("symbol_ratio") == 0) & (F.col("digit_ratio") == 0) & (F.col("punct_line_share") == 0)
    return F.when(blank, "empty").when((F.col("n_words") > 0) & (F.col("distance2") <= threshold), "prose").otherwise("junk")
