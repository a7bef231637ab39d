"""Problem 8: evaluation texts leaking into documents.

One Aho-Corasick automaton holds every run of ``n`` words of the evaluation items. Each distinct
word of the items gets one character of its own, so a pattern is a string of ``n`` characters and a
document is scanned as one character per word (words the items never use become a separator). A
hit at word ``i`` is mapped back to characters through the word spans of the original text.

The items are evaluation material and stay small; the automaton is built in every worker from a
broadcast list whose size is checked before any is fetched (``max_item_words``). Beyond that bound the items are cut by the hash
of their ids into several automata, fetched one after the other, and the documents are scanned once for each: no item is dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_batches
from .words import word_spans, words

RUN_WORDS = 14
#: Words of evaluation text one automaton may hold (about 60 bytes each in a worker).
MAX_ITEM_WORDS = 1_000_000
_SEPARATOR = "\x00"
#: Codes start above the ASCII range and stay clear of the surrogates.
_FIRST, _SURROGATES, _AFTER, _MOST = 0x100, 0xD800, 0xE000, 0x110000 - 0x800


class ItemAutomaton:
    """The word alphabet and the automaton over all ``n``-word runs of ``items`` [(id, text)]."""

    def __init__(self, items: list[tuple[int, str]], n: int = RUN_WORDS) -> None:
        self.items, self.n, self._built = items, n, None

    def __getstate__(self) -> dict:
        return {"items": self.items, "n": self.n, "_built": None}

    def _build(self) -> tuple:
        import ahocorasick

        alphabet: dict[str, str] = {}
        runs: dict[str, set[int]] = {}
        for item, text in self.items:
            coded = []
            for w in words(text or ""):
                if w not in alphabet:
                    code = _FIRST + len(alphabet)
                    if code >= _MOST:
                        raise ValueError("the evaluation items have more distinct words than there are characters; lower max_item_words")
                    alphabet[w] = chr(code if code < _SURROGATES else code - _SURROGATES + _AFTER)
                coded.append(alphabet[w])
            line = "".join(coded)
            for i in range(len(line) - self.n + 1):
                runs.setdefault(line[i : i + self.n], set()).add(item)
        automaton = ahocorasick.Automaton()
        for run, ids in runs.items():
            automaton.add_word(run, tuple(sorted(ids)))
        if runs:
            automaton.make_automaton()
        return alphabet, automaton if runs else None

    def scan(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each leaked item: first and last character and the number of words inside hits."""
        if self._built is None:
            self._built = self._build()
        alphabet, automaton = self._built
        if automaton is None:
            return {}
        get = alphabet.get
        line = "".join([get(w, _SEPARATOR) for w in words(text)])
        ends: dict[int, list[int]] = {}
        for end, ids in automaton.iter(line):
            for item in ids:
                ends.setdefault(item, []).append(end)
        if not ends:
            return {}
        spans = word_spans(text)[1]
        out = {}
        for item, at in ends.items():
            covered, last = 0, -1
            for end in at:
                covered += end - max(last, end - self.n)
                last = end
            out[item] = (spans[at[0] - self.n + 1][0], spans[at[-1]][1], covered)
        return out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = RUN_WORDS,
    max_item_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_words, start, end): each document with each item it shares ``n`` words in a row with.

    ``start`` and ``end`` are character offsets in the document (from the first hit to the end of
    the last), ``n_words`` the words inside hits. Null, empty and shorter texts, and items of fewer
    than ``n`` words, give no rows; a redelivered document gives its row once; other columns of the
    inputs are ignored. No shuffle but the final one over the few hits.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    key = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    # a word has two bytes at least, with what parts it from the next
    size = F.coalesce(F.sum(F.octet_length("t")), F.lit(0)) / 2
    groups = -(-int(rows.agg(size).first()[0]) // max_item_words)
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null")
    schema = f"doc_id {kind}, item_id {key}, n_words int, start int, end int"
    out = None
    for g in range(max(1, groups)):
        own = rows if groups < 2 else rows.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(groups)) == g)
        part = map_batches(source, _scanner(docs.sparkSession, ItemAutomaton([(r[0], r[1]) for r in own.orderBy("i", "t").collect()], n)), schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scanner(spark: SparkSession, automaton: ItemAutomaton):
    shared = spark.sparkContext.broadcast(automaton)

    def scan(batch: pa.RecordBatch) -> dict | None:
        rows = []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for item, (start, end, covered) in shared.value.scan(t).items():
                rows.append((d, item, covered, start, end))
        if not rows:
            return None
        return dict(zip(("doc_id", "item_id", "n_words", "start", "end"), zip(*rows)))

    return scan
