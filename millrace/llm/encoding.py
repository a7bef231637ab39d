"""Problem 9: text garbled by a wrong character encoding, found and restored by round trips.

A garbling cost is learned from all documents: minus the logarithm of the frequency of neighbouring
characters, of which garbled ones are a small part. Each distinct text counts once, so that no number of
copies makes its own garbled pairs look usual. Pairs of letters of one script other than Latin are
counted against their script alone, so that a language costs the same whatever its share of the documents; all others against
everything, as a frequency given the character before would hide garbled ones, which follow one another regularly too.

A token, the text between blanks, without a costly pair is sound. Others are
taken back: encoded in a legacy encoding, decoded strictly in an intended one. Of the pairs of
encodings the one wins whose repairs lower the cost of the text most. It is then applied to the whole stretch from the first to the last of
these tokens, and beyond it as far as the cost doesn't rise. This is repeated for nested layers until no
pair of encodings lowers the cost.

What only wrong decoding leaves behind (replacement characters, C1 controls) costs as much as a pair never seen; a text
with such a cost left is a case even where nothing can be restored. A sequence quoted as a topic, near the very character it
stands for, is none.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches, map_partition
from ..session import materialise

#: Pairs of characters the cost model keeps for each script, most frequent first; rarer ones cost as much as half the least frequent kept.
MODEL_PAIRS = 400_000
#: Cost (nats) of a pair of characters up to which a token is only tried as UTF-8, and mean cost up to which a repair is sound.
LOOK, SOUND = 10.5, 12.5
#: Cost a token must lose, and a text in all; single-byte swaps, which have no structure to prove them, more.
TOKEN_DROP, TEXT_DROP, SWAP_TOKEN_DROP, SWAP_DROP = 2.5, 2.5, 4.5, 14.0
#: Letters a token must have to be evidence of a single-byte swap.
SWAP_LETTERS = 3
#: Share of the tokens of a stretch a swap must make cheaper.
SWAP_AGREED = 0.75
#: How far from a quoted sequence the character it stands for may be.
QUOTE_CHARS = 60
_REMEMBERED = 100_000
_UNSEEN = 0.3

#: The encodings text is wrongly read in, and those it is written in.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "iso8859-2")
MULTI = ("gbk", "cp932", "big5", "euc_jp", "euc_kr")
READ_IN = SINGLE + ("gbk", "cp932", "big5")
WRITTEN_IN = ("utf-8",) + MULTI + ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850")
PAIRS = tuple((r, w) for r in READ_IN for w in WRITTEN_IN if r != w and not (r in MULTI and w != "utf-8"))

UTF8_PAIRS = tuple(p for p in PAIRS if p[1] == "utf-8")

_RUN = re.compile(r"[^\x00-\x7f]{2}")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: What only wrong decoding leaves behind: C1 controls and the replacement character.
_LEFT_BEHIND = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
_REPLACEMENT = "\ufffd"
_CJK = re.compile("[぀-ヿ㐀-鿿가-힣]")
#: Not what strict decoding of sound text gives: Latin letters grown together with others, private or half-width characters.
_ODD = re.compile("[A-Za-z][぀-ヿ㐀-鿿가-힣Ѐ-ӿͰ-Ͽ]|[぀-ヿ㐀-鿿가-힣Ѐ-ӿͰ-Ͽ][A-Za-z]|[\ue000-\uf8ff\uff61-\uff9f]")


def _encode(text: str, legacy: str) -> bytes | None:
    """``text`` in a legacy encoding; in cp1252 and the like, undefined bytes stand for the C1 controls."""
    try:
        return text.encode(legacy)
    except UnicodeError:
        if not legacy.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(legacy)
        except UnicodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def round_trip(text: str, legacy: str, intended: str) -> str | None:
    """``text`` taken back, or None if it can't be. UTF-8 is decoded for each run of non-ASCII characters that is valid."""
    if intended == "utf-8" and legacy not in MULTI:
        changed = False

        def run(m: re.Match) -> str:
            nonlocal changed
            raw = _encode(m.group(), legacy)
            if raw is None:
                return m.group()
            try:
                out = raw.decode("utf-8")
            except UnicodeError:
                return m.group()
            changed = True
            return out

        out = _HIGH.sub(run, text)
        return out if changed else None
    raw = _encode(text, legacy)
    return None if raw is None else _decode(raw, intended)


def _decode(raw: bytes, intended: str) -> str | None:
    """Strictly."""
    try:
        return raw.decode(intended)
    except UnicodeError:
        return None


#: Scripts whose pairs of letters are counted apart.
_SCRIPTS = (("Ͱ", "Ͽ"), ("Ѐ", "ԯ"), ("԰", "֏"), ("֐", "׿"), ("؀", "ۿ"), ("ऀ", "\u0dff"), ("฀", "\u0eff"), ("Ⴀ", "ჿ"), ("⺀", "ꓯ"), ("가", "힣"), ("豈", "\ufaff"))

#: About how many letters a script has in use, if not 100.
_LETTERS = {9: 3000, 10: 2000, 11: 3000}


def script(pair: str) -> int:
    """The script both characters of a pair are letters of, or 0 for Latin, mixed and other pairs."""
    a, b = pair
    if a < "Ͱ" or b < "Ͱ" or not (a.isalpha() and b.isalpha()):
        return 0
    for i, (low, high) in enumerate(_SCRIPTS, 1):
        if low <= a <= high:
            return i if low <= b <= high else 0
    return 0


class CostModel:
    """The garbling cost: ``pairs`` has the count of each pair kept, ``totals`` of each script all occurrences and the least count kept (0 for all)."""

    def __init__(self, pairs: dict[str, int], totals: dict[int, tuple[int, int]]) -> None:
        log = {k: math.log(max(1, n)) for k, (n, _) in totals.items()}
        self.costs = {p: log[script(p)] - math.log(n) for p, n in pairs.items()}
        # of a script with few texts, an unseen pair costs as much as any of all pairs of its letters
        self.unseen = {
            k: math.log(max(n, _UNSEEN * _LETTERS.get(k, 100) ** 2)) - math.log(max(_UNSEEN, least / 2))
            for k, (n, least) in ({k: (1, 0) for k in range(len(_SCRIPTS) + 1)} | totals).items()
        }
        self._finish()

    @classmethod
    def of(cls, pairs: dict[str, int]) -> CostModel:
        """The model of all counts."""
        totals: dict[int, tuple[int, int]] = {}
        for p, n in pairs.items():
            totals[script(p)] = (totals.get(script(p), (0, 0))[0] + n, 0)
        return cls(pairs, totals)

    def _finish(self) -> None:
        # in a script with few texts, a pair of a few occurrences is costly already
        self.rare = {k: c - math.log(10) for k, c in self.unseen.items()}
        self._cost: dict[str, tuple[float, float]] = {}
        self._repairs: dict[str, dict] = {}

    def __getstate__(self) -> tuple:
        return self.costs, self.unseen

    def __setstate__(self, state: tuple) -> None:
        self.costs, self.unseen = state
        self._finish()

    def pair(self, p: str) -> float:
        """The cost of two neighbouring characters."""
        if _LEFT_BEHIND.search(p):
            return self.unseen[0]
        got = self.costs.get(p)
        return self.unseen[script(p)] if got is None else got

    def _of(self, token: str) -> tuple[float, float]:
        got = self._cost.get(token)
        if got is None:
            t = f" {token.lower()} "
            each = list(map(self.costs.get, map(str.__add__, t, t[1:])))
            if None in each or _LEFT_BEHIND.search(t):
                each = [self.pair(t[i : i + 2]) for i in range(len(t) - 1)]
            got = (sum(each), max(each))
            if len(token) < 40:
                if len(self._cost) > _REMEMBERED:
                    self._cost.clear()
                self._cost[token] = got
        return got

    def cost(self, token: str) -> float:
        """Total cost of a token, its borders included."""
        return self._of(token)[0]

    def bearable(self, token: str) -> float:
        """What the repair of a token beside a garbled stretch may cost."""
        total, worst = self._of(token)
        return total + (TOKEN_DROP if worst > LOOK else 0.0)

    def residue(self, text: str) -> float:
        """What the characters that only wrong decoding leaves behind cost above the bound for sound pairs."""
        t = f" {text} "
        return sum(self.pair(t[i : i + 2]) - LOOK for m in _LEFT_BEHIND.finditer(t) for i in (m.start() - 1, m.start()))

    def repairs(self, token: str) -> dict[tuple[str, str], tuple[str, float]]:
        """For each pair of encodings that lowers the cost clearly: the repaired token and the drop."""
        got = self._repairs.get(token)
        if got is None:
            got = {}
            before, worst = self._of(token)
            odd = worst > LOOK or any(self.pair(p) >= self.rare[script(p)] for p in map(str.__add__, f" {token.lower()}", f"{token.lower()} ") if not p.isascii())
            runs = _RUN.search(token) is not None  # UTF-8 has no single bytes of other than ASCII characters
            if odd or runs:
                raws = {legacy: _encode(token, legacy) for legacy in READ_IN} if odd else {}
                for pair in PAIRS if odd else UTF8_PAIRS:
                    if pair[1] == "utf-8" and pair[0] not in MULTI:
                        fixed = self.taken_back(token, pair) if runs else None
                    else:
                        raw = raws[pair[0]] if odd else _encode(token, pair[0])
                        fixed = self._sound(token, None if raw is None else _decode(raw, pair[1]), pair)
                    if fixed is None or (pair[1] in MULTI and len(_CJK.findall(fixed)) < 2):
                        continue
                    after = self.cost(fixed)
                    if before - after >= (TOKEN_DROP if _structured(pair) else SWAP_TOKEN_DROP) and after <= SOUND * (len(fixed) + 1):
                        got[pair] = (fixed, before - after)
            if len(token) < 40:
                if len(self._repairs) > _REMEMBERED:
                    self._repairs.clear()
                self._repairs[token] = got
        return got

    @staticmethod
    def taken_back(token: str, pair: tuple[str, str]) -> str | None:
        """The token re-encoded and decoded strictly, if that changes it to something text can be."""
        return CostModel._sound(token, round_trip(token, *pair), pair)

    @staticmethod
    def _sound(token: str, fixed: str | None, pair: tuple[str, str]) -> str | None:
        if fixed is None or fixed == token or _REPLACEMENT in fixed or (pair[1] != "utf-8" and _ODD.search(fixed)):
            return None
        return fixed


def restore(text: str, model: CostModel) -> tuple[str, list[str], int, str]:
    """The restored text, the layers taken off ("read>written"), the tokens the first layer changed, and the text without quoted sequences."""
    layers: list[str] = []
    changed, plain = 0, text
    while True:  # every layer lowers the cost, so this ends
        drops: dict[tuple[str, str], float] = defaultdict(float)
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text) if not m.group().isascii()]
        options = [model.repairs(t) for _, _, t in tokens]
        for (_, _, token), found in zip(tokens, options):
            if found:
                letters = sum(c.isalpha() for c in token)
                for pair, (_, drop) in found.items():
                    if _structured(pair) or letters >= SWAP_LETTERS:
                        drops[pair] += drop
        best = None
        for pair in sorted(drops, key=lambda p: (-drops[p], PAIRS.index(p))):
            if drops[pair] < (TEXT_DROP if _structured(pair) else SWAP_DROP):
                break
            sure = [i for i, found in enumerate(options) if pair in found]
            if not _structured(pair):
                sure = _agreed(tokens, sure, pair, model)
            if sure:
                best = pair
                break
        if best is None:
            break
        if not layers:
            quoted = [(*tokens[i][:2], options[i][best][0]) for i in sure if best in options[i]]
            if _quoted(text, quoted):
                plain = _replaced(text, [(a, b, "") for a, b, _ in quoted])
                break
        taken = _stretch(tokens, sure, best, model)
        if not layers:
            changed = len(taken)
        text = _replaced(text, taken)
        layers.append(f"{best[0]}>{best[1]}")
    return text, layers, changed, plain


def _agreed(tokens: list[tuple[int, int, str]], sure: list[int], pair: tuple[str, str], model: CostModel) -> list[int]:
    """Those of ``sure`` in the stretch of tokens that a swap of single bytes makes cheapest; none if it isn't enough, or too few tokens of the stretch get cheaper."""
    drops = []
    for _, _, token in tokens[sure[0] : sure[-1] + 1]:
        out = model.taken_back(token, pair)
        drops.append(0.0 if out is None else model.cost(token) - model.cost(out))
    best, start, total, begin = (0.0, 0, 0), 0, 0.0, 0
    for i, d in enumerate(drops):  # the stretch of the largest sum
        if total <= 0:
            total, begin = 0.0, i
        total += d
        if total > best[0]:
            best = (total, begin, i + 1)
    total, start, end = best
    inside = drops[start:end]
    if total < SWAP_DROP or sum(d > 0 for d in inside) < SWAP_AGREED * len(inside):
        return []
    return [i for i in sure if start <= i - sure[0] < end]


def _stretch(tokens: list[tuple[int, int, str]], sure: list[int], pair: tuple[str, str], model: CostModel) -> list[tuple[int, int, str]]:
    """The repairs of the stretch that has the tokens ``sure``: all of it that decodes, and its neighbours as far as they get no costlier, or hardly and have a costly pair."""
    first, last = sure[0], sure[-1]
    got = {i: model.taken_back(tokens[i][2], pair) for i in range(first, last + 1)}
    for step, i in ((-1, first - 1), (1, last + 1)):
        while 0 <= i < len(tokens) and (out := model.taken_back(tokens[i][2], pair)) is not None and model.cost(out) <= model.bearable(tokens[i][2]):
            got[i] = out
            i += step
    return [(*tokens[i][:2], got[i]) for i in sorted(got) if got[i] is not None]


def _replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, new in parts:
        out += [text[last:a], new]
        last = b
    return "".join(out) + text[last:]


def _structured(pair: tuple[str, str]) -> bool:
    """Whether decoding strictly is evidence by itself."""
    return pair[1] == "utf-8" or pair[1] in MULTI


def _quoted(text: str, taken: list[tuple[int, int, str]]) -> bool:
    """Whether the only garbled tokens are sequences quoted beside the characters they stand for."""
    for a, b, fixed in taken:
        core = re.sub(r"[\x00-\x7f]", "", fixed)
        if not core or re.search(r"[A-Za-z0-9]", fixed):
            return False
        near = text[max(0, a - QUOTE_CHARS) : a] + " " + text[b : b + QUOTE_CHARS]
        if core not in near:
            return False
    return True


def cost_model(docs: DataFrame, text: str = "text", size: int = MODEL_PAIRS) -> CostModel:
    """The model of all distinct texts that have non-ASCII characters; the table kept is of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32) for t in batch.column(0).to_pylist()]
            points = np.concatenate(parts).astype(np.uint64)
            points[(points == 9) | (points == 10) | (points == 13)] = 32
            pair, n = np.unique((points[:-1] << np.uint64(21)) | points[1:], return_counts=True)
            pair = pair.view(np.int64)
            high = np.flatnonzero((pair >> 21 >= 0x370) & (pair & 0x1FFFFF >= 0x370))
            kind = np.zeros(len(pair), np.int32)
            kind[high] = [script(chr(p >> 21) + chr(p & 0x1FFFFF)) for p in pair[high].tolist()]
            yield {"script": kind, "pair": pair, "n": n}

    # copies meet map-side
    texts = docs.where(F.col(text).isNotNull() & (F.length(text) != F.octet_length(text))).select(text).distinct()
    counted = map_partition(texts, count, "script int, pair bigint, n bigint").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "p9-pairs")
    totals: dict[int, tuple[int, int]] = {}
    # of each script, how many pairs have which count: as many rows as there are counts, so the rarest are told apart and the others by powers
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16) + 1024)
    levels = counted.groupBy("script", level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum("n").alias("n")).collect()
    bounds = []
    for k in {r["script"] for r in levels}:
        room, least = size, 2
        for r in sorted((r for r in levels if r["script"] == k and r["least"] > 1), key=lambda r: -r["least"]):
            room -= r["k"]
            if room < 0:
                break
            least = r["least"]
        totals[k] = (sum(r["n"] for r in levels if r["script"] == k), least if room < 0 else 0)
        bounds.append((F.col("script") == k) & (F.col("n") >= least))
    if not bounds:
        return CostModel({}, {})
    kept = counted.where(reduce(or_, bounds)).select("pair", "n").collect()
    return CostModel({chr(r[0] >> 21) + chr(r[0] & 0x1FFFFF): r[1] for r in kept}, totals)


def garbled(docs: DataFrame, model: CostModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, evidence, layers, n_tokens, restored) of the garbled documents.

    ``evidence`` is "repair", "replacement" (U+FFFD) or "control" (C1 controls); ``restored`` is the text with
    every accepted repair, null where nothing could be restored. Null, empty and ASCII texts are never
    garbled; a repeated row gives a repeated row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.where(F.col(text).isNotNull() & (F.length(text) != F.octet_length(text))).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> dict | None:
        rows, model = [], shared.value
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fixed, layers, n, plain = restore(t, model)
            evidence = "repair" if layers else None
            if evidence is None and model.residue(plain) >= TEXT_DROP:
                evidence = "replacement" if _REPLACEMENT in plain else "control"
            if evidence:
                rows.append((d, evidence, ",".join(layers), n, fixed if layers else None))
        return dict(zip(("doc_id", "evidence", "layers", "n_tokens", "restored"), zip(*rows))) if rows else None

    return map_batches(source, run, f"doc_id {kind}, evidence string, layers string, n_tokens int, restored string")
