"""Language of a text: naive Bayes over character n-grams, fitted on labelled documents.

The fit takes a bounded sample (``SAMPLE_DOCS`` documents a language, chosen by the hash of their id),
as labels are known to be partly wrong: sampled documents the first fit contradicts are left out of
the second. Scoring is by word, with the words' scores kept, so long texts cost little more than their words.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import words

#: Labelled documents per language, and the longest document, the fit takes.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
#: Labels that name no language.
NO_LANGUAGE = ("und", "mul", "zxx", "")
_SMOOTH = 0.3
_REMEMBERED = 150_000


def grams(word: str) -> list[str]:
    """Character 1- to 4-grams of a word with its ends marked; of scripts without blanks 1- and 2-grams."""
    if word[0] >= "⺀":
        return list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


class LanguageModel:
    """Log probabilities of n-grams per language."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray], unseen: np.ndarray) -> None:
        self.langs, self.table, self.unseen = langs, table, unseen
        self._known: dict[str, int] = {}
        self._rows = np.zeros((0, len(langs)))

    def __getstate__(self) -> tuple:
        return self.langs, self.table, self.unseen

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @classmethod
    def fit(cls, sample: list[tuple[str, str]]) -> LanguageModel:
        """From (language, text); a sample the first model contradicts is left out of the second."""
        model = cls._fit(sample)
        kept = [(lang, t) for lang, t in sample if model.best(t) == lang]
        return model._fit(kept) if {k for k, _ in kept} == {k for k, _ in sample} else model

    @classmethod
    def _fit(cls, sample: list[tuple[str, str]]) -> LanguageModel:
        langs = sorted({lang for lang, _ in sample})
        counts = {lang: Counter() for lang in langs}
        for lang, text in sample:
            for w in words(text):
                if not w.isdigit():
                    counts[lang].update(grams(w))
        sums = np.array([sum(counts[x].values()) for x in langs], float)
        vocabulary = set().union(*counts.values()) if langs else set()
        size = len(vocabulary) + 1
        total = np.log(sums + _SMOOTH * size)
        table = {g: np.log(np.array([counts[x][g] for x in langs]) + _SMOOTH) - total for g in vocabulary}
        return cls(langs, table, math.log(_SMOOTH) - total)

    def word(self, w: str) -> np.ndarray:
        """Log likelihood of a word in each language; zeros for numbers."""
        return self._rows[self._at(w)]

    def _at(self, w: str) -> int:
        at = self._known.get(w)
        if at is None:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            at = self._known[w] = len(self._known)
            if at >= len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros((max(1024, at), len(self.langs)))])
            row = np.zeros(len(self.langs))
            if not w.isdigit():
                get, unseen = self.table.get, self.unseen
                for g in grams(w):
                    row += get(g, unseen)
            self._rows[at] = row
        return at

    def scores(self, ws: list[str]) -> np.ndarray:
        """Log likelihoods of the words together."""
        return self.scores_and_likeliest(ws)[0]

    def scores_and_likeliest(self, ws: list[str]) -> tuple[np.ndarray, float]:
        """Log likelihoods of the words together, and their sum with each word in its likeliest language."""
        total, likeliest = np.zeros(len(self.langs)), 0.0
        if not self.langs:
            return total, likeliest
        for i in range(0, len(ws), 50_000):
            part = ws[i : i + 50_000]
            if len(self._known) + len(part) > _REMEMBERED:
                self._known.clear()
            at = list(map(self._known.get, part))
            if None in at:
                at = list(map(self._at, part))
            rows = self._rows[at]
            total += rows.sum(axis=0)
            likeliest += float(rows.max(axis=1).sum())
        return total, likeliest

    def posterior(self, ws: list[str]) -> dict[str, float]:
        """Probability of each language, with equal priors."""
        s = self.scores(ws)
        p = np.exp(s - s.max()) if len(s) else s
        return dict(zip(self.langs, (p / p.sum()).tolist())) if len(s) else {}

    def best(self, text: str) -> str | None:
        ws = [w for w in words(text) if not w.isdigit()]
        return self.langs[int(np.argmax(self.scores(ws)))] if ws and self.langs else None


def labelled_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``size`` (language, text) a language; languages with few documents have few."""
    code = F.lower(F.substring_index(F.trim(F.col(lang)), "-", 1)).alias("lang")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(F.col(text)) <= SAMPLE_CHARS)).select(code, F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"))
    ranked = rows.where(~F.col("lang").isin(*NO_LANGUAGE)).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return [(r[0], r[1]) for r in ranked.where(F.col("k") <= size).select("lang", "text").collect()]


def fit_language_model(docs: DataFrame, **columns: str) -> LanguageModel:
    """The model of a (doc_id, text, lang) table."""
    return LanguageModel.fit(labelled_sample(docs, **columns))
