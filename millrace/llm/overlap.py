"""Problem 1: same or near-same records across splits, an exact prefix-filter join.

Two records belong together if their texts are equal or the Jaccard similarity of their sets of
``n``-word shingles is at least ``t``. The join is bipartite: evaluation records on one side, training
records on the other.

1. A sketch of fixed size is made of the evaluation side's shingles: a bitmap of those that occur and
   saturating counts. Shingles are ordered by (count, hash), rare ones first. Any order known to both
   sides keeps the prefix filter exact; the sketch only decides how well it prunes. Its size follows
   the evaluation side up to ``MAX_BITS`` (enough for about 170 MB of evaluation text); beyond that more candidates survive, none is lost.
2. A record of ``m`` shingles is indexed by its first ``m - ceil(t m) + k`` (``PREFIX_SHARED``): two records with Jaccard
   >= t share ``k`` of them, or all they must share if that is less. A training record with fewer than ``ceil(t m)`` shingles in the bitmap can't
   have a partner and is dropped in the scan; of the others only prefix shingles in a second bitmap, of
   the index, are sent, and only if there are ``k``.
3. Index and probes, without their texts, are joined on the shingle and filtered by length and position, of each match and of all of a
   pair together. Nothing is made
   distinct before the join, so a shingle that very many training records have is split by the engine's handling of skew.
4. A third bitmap, of the texts in a candidate pair, keeps all other texts out of the last joins: there the texts of the candidates, equal
   texts taken as one, are compared exactly, as sets of words.

Copies of one text share a fingerprint and are one class throughout; ids come back in the last step, from a narrow table of (id, fingerprint)
that is written once. Texts move only if they are candidates.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches, map_partition
from ..session import materialise
from .words import words

#: The statement of the problem: three words, 0.6.
SHINGLE_WORDS, SIMILARITY = 3, 0.6
#: Bits of the bitmap: 8 for each evaluation shingle, within these bounds (2^28 bits are 32 MB); a count of a byte for every 8 bits.
MIN_BITS, MAX_BITS = 20, 28
#: Prefix shingles a pair must share. The more, the fewer candidates and the longer the prefixes, by one each.
PREFIX_SHARED = 4
_PARTS = 16
_REMEMBERED = 300_000
_REMEMBERED_TEXTS = 100_000


def _word_hash(known: dict[str, int], w: str) -> int:
    import xxhash

    h = known[w] = xxhash.xxh3_64_intdigest(w)
    return h


def shingle_hashes(ws: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``n``-word shingles of ``ws``."""
    if len(ws) < n:
        return np.zeros(0, np.uint64)
    if len(known) > _REMEMBERED:
        known.clear()
    get = known.get
    h = np.array([get(w) or _word_hash(known, w) for w in ws], np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Sketch:
    """Which shingles the evaluation side has, and about how often."""

    def __init__(self, bits: int, bitmap: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.bitmap, self.counts = bits, bitmap, counts

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def order(self, h: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Indices of ``h`` (sorted), rarest first; shingles not there are the rarest."""
        count = np.where(there, self.counts[h & np.uint64(len(self.counts) - 1)].astype(np.int16) + 1, 0)
        return np.argsort(count, kind="stable")


def build_sketch(rows: DataFrame, n_shingles: int, n: int | None) -> Sketch:
    """The sketch of a one-column frame of texts, or for ``n`` None of hashes; each task sends its own, of fixed size and compressed."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(8 * max(1, n_shingles)))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bitmap, counts = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        known: dict[str, int] = {}
        some = False
        for batch in batches:
            each = [batch.column(0).to_numpy().view(np.uint64)] if n is None else (shingle_hashes(words(t), n, known) for t in batch.column(0).to_pylist())
            for h in each:
                if len(h):
                    some = True
                    at = h >> np.uint64(64 - bits)
                    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                    slot = np.unique(h & np.uint64(len(counts) - 1))
                    counts[slot] = np.minimum(counts[slot], 254) + 1
        if some:
            yield {"part": list(range(_PARTS)), "bitmap": [zlib.compress(x.tobytes(), 1) for x in np.split(bitmap, _PARTS)], "counts": [zlib.compress(x.tobytes(), 1) for x in np.split(counts, _PARTS)]}

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bitmap, counts = 0, 0
        for b, c in zip(pdf["bitmap"], pdf["counts"]):
            bitmap = bitmap | np.frombuffer(zlib.decompress(b), np.uint8)
            counts = np.minimum(counts + np.frombuffer(zlib.decompress(c), np.uint8).astype(np.uint16), 255)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bitmap": [zlib.compress(bitmap.tobytes(), 1)], "counts": [zlib.compress(counts.astype(np.uint8).tobytes(), 1)]})

    schema = "part int, bitmap binary, counts binary"
    parts = map_partition(rows, partial, schema).groupBy("part").applyInPandas(merge, schema).orderBy("part").collect()
    if not parts:
        return Sketch(bits, np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8))
    return Sketch(bits, *(np.concatenate([np.frombuffer(zlib.decompress(r[i]), np.uint8) for r in parts]) for i in (1, 2)))


_PREFIX = "fp binary, key bigint, n int, text string, probes array<struct<h:bigint,pos:int>>"


def _prefixes(texts: DataFrame, sketch: Sketch, indexed: Sketch | None, n: int, t: float) -> DataFrame:
    """(fp, key, n, text, probes) of the records that may have a partner; input (text, fp, key). Probes outside ``indexed`` are left out."""
    shared = texts.sparkSession.sparkContext.broadcast((sketch, indexed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[str, int] = {}
        sketch, indexed = shared.value
        seen: set[bytes] = set()  # a text that many records have is sent once in a while, not each time
        for batch in batches:
            rows: list[tuple] = []
            if len(seen) > _REMEMBERED_TEXTS:
                seen.clear()
            for text, fp, key in zip(*(c.to_pylist() for c in batch.columns)):
                if fp in seen:
                    continue
                seen.add(fp)
                h = shingle_hashes(words(text), n, known)
                m = len(h)
                need = math.ceil(t * m - 1e-9)
                there = sketch.has(h)
                if not m or there.sum() < need:
                    continue
                first = sketch.order(h, there)[: m - need + PREFIX_SHARED]
                at = np.flatnonzero(there[first] if indexed is None else indexed.has(h[first]) & there[first])
                if len(at) >= min(PREFIX_SHARED, need):
                    rows.append((fp, key, m, text, [{"h": a, "pos": b} for a, b in zip(h[first[at]].view(np.int64).tolist(), at.tolist())]))
            if rows:
                yield dict(zip(("fp", "key", "n", "text", "probes"), zip(*rows)))

    return map_partition(texts, run, _PREFIX)


def _verify(pairs: DataFrame, n: int, t: float) -> DataFrame:
    """(fp_e, fp_t, similarity) of the pairs (fp_e, fp_t, text_e, text_t) that reach ``t``."""

    def shingles(text: str) -> set:
        ws = words(text)
        return set(zip(*(ws[i:] for i in range(n))))

    def run(batch: pa.RecordBatch) -> dict | None:
        known: dict[bytes, set] = {}
        rows = []
        for e, f, te, tf in zip(*(c.to_pylist() for c in batch.columns)):
            a = known[e] if e in known else known.setdefault(e, shingles(te))
            b = known[f] if f in known else known.setdefault(f, shingles(tf))
            both = len(a & b)
            union = len(a) + len(b) - both
            if union and both >= t * union - 1e-9:
                rows.append((e, f, both / union))
        return dict(zip(("fp_e", "fp_t", "similarity"), zip(*rows))) if rows else None

    return map_batches(pairs.select("fp_e", "fp_t", "text_e", "text_t"), run, "fp_e binary, fp_t binary, similarity double")


def similar_classes(left: DataFrame, right: DataFrame, text: str, n: int = SHINGLE_WORDS, t: float = SIMILARITY, n_bytes: int | None = None) -> DataFrame:
    """(fp_e, fp_t, similarity): pairs of different texts of ``left`` and ``right``, by fingerprint, with Jaccard >= ``t``.

    The fingerprint is the MD5 of the text. Each pair of texts comes once, however many records have them. ``n_bytes`` is the size of ``left``'s texts, if known.
    """
    def base(df: DataFrame) -> DataFrame:
        fp = fingerprint(F.col(text))
        # the short key stands for the text until texts are compared; a collision only adds a comparison
        return df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), fp.alias("fp"), F.xxhash64(fp).alias("key"))

    evals = base(left)
    # about a shingle per five bytes; only the size of the sketch depends on it
    n_bytes = left.agg(F.sum(F.octet_length(text))).first()[0] or 0 if n_bytes is None else n_bytes
    sketch = build_sketch(evals.select("text"), n_bytes // 5, n)
    index = materialise(_prefixes(evals, sketch, None, n, t), "p1-index")
    indexed = build_sketch(index.select(F.explode("probes.h")), n_bytes // 10, None)
    probes = materialise(_prefixes(base(right), sketch, indexed, n, t), "p1-probes")

    def flat(df: DataFrame, side: str) -> DataFrame:
        return df.select("key", "n", F.inline("probes")).select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "pos")))

    need = F.ceil((F.col("n_e") + F.col("n_t")) * (t / (1 + t)) - 1e-9)
    shared = F.least(F.lit(PREFIX_SHARED), need)
    # all shared shingles up to the last one in both prefixes are seen; of the rest the shorter end bounds their number
    rest = lambda i, j: F.least(F.col("n_e") - i, F.col("n_t") - j)
    candidates = (
        flat(index, "e")
        .join(flat(probes, "t"), "h")
        .where((F.least("n_e", "n_t") >= t * F.greatest("n_e", "n_t") - 1e-9) & (rest(F.col("pos_e"), F.col("pos_t")) > need - PREFIX_SHARED))
        .groupBy("key_e", "key_t", "n_e", "n_t")
        .agg(F.count("*").alias("seen"), F.max("pos_e").alias("last_e"), F.max("pos_t").alias("last_t"))
        .where((F.col("seen") >= shared) & (F.col("seen") + rest(F.col("last_e") + 1, F.col("last_t") + 1) >= need))
        .select("key_e", "key_t")
        .distinct()
    )
    candidates = materialise(candidates, "p1-candidates")
    wanted = build_sketch(candidates.select(F.explode(F.array("key_e", "key_t"))), 2 * candidates.count(), None)

    def texts(df: DataFrame, side: str) -> DataFrame:
        named = _among(df.select("key", "fp", "text"), wanted).select(*(F.col(c).alias(f"{c}_{side}") for c in ("key", "fp", "text")))
        return named.dropDuplicates([f"key_{side}", f"fp_{side}"])

    both = candidates.join(texts(probes, "t"), "key_t").join(texts(index, "e"), "key_e")
    return _verify(both.where(F.col("fp_e") != F.col("fp_t")), n, t)


def _among(rows: DataFrame, wanted: Sketch) -> DataFrame:
    """The rows whose key, the first column, the sketch has, and a few others."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> dict | None:
        kept = batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy().view(np.uint64))))
        return dict(zip(kept.schema.names, kept.columns)) if kept.num_rows else None

    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def fingerprint(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _sides(records: DataFrame, record_id: str, text: str, split: str, train: str) -> tuple[DataFrame, DataFrame]:
    rows = records.where(F.col(text).isNotNull() & F.col(split).isNotNull() & F.col(record_id).isNotNull())
    return rows.where(F.col(split) != train), rows.where(F.col(split) == train)


def _members(records: DataFrame, record_id: str, text: str, split: str, train: str, keep: list[str]) -> DataFrame:
    """(id, fp, is_eval, size, <keep>) of all records that count, redelivered ones once; written, as it is much narrower than the texts."""
    rows = records.where(F.col(text).isNotNull() & F.col(split).isNotNull() & F.col(record_id).isNotNull())
    named = rows.select(F.col(record_id).alias("id"), fingerprint(F.col(text)).alias("fp"), (F.col(split) != train).alias("is_eval"), F.octet_length(text).cast("bigint").alias("size"), *(F.col(c).alias(f"__{c}") for c in keep))
    out = named.groupBy("id", "fp", "is_eval").agg(F.min("size").alias("size"), *(F.min(f"__{c}").alias(f"__{c}") for c in keep))
    return materialise(out, "p1-members")


def _side(members: DataFrame, side: str, keep: list[str]) -> DataFrame:
    short = "e" if side == "eval" else "t"
    return members.where(F.col("is_eval") == F.lit(side == "eval")).select(F.col("id").alias(f"id_{side}"), F.col("fp").alias(f"fp_{short}"), *(F.col(f"__{c}").alias(f"{c}_{side}") for c in keep))


def _near(records: DataFrame, members: DataFrame, record_id: str, text: str, split: str, train: str, n: int, t: float) -> DataFrame:
    evals, trains = _sides(records, record_id, text, split, train)
    size = members.where("is_eval").agg(F.sum("size")).first()[0] or 0
    return similar_classes(evals, trains, text, n, t, size)


def overlap_links(records: DataFrame, keep: list[str], record_id: str = "id", text: str = "text", split: str = "split", train: str = "train", n: int = SHINGLE_WORDS, t: float = SIMILARITY) -> DataFrame:
    """(id_eval, <keep>_eval, class, n_copies, n_near) of every evaluation record with a partner, without listing pairs.

    ``class`` is the MD5 of its text, ``n_copies`` the training records of the same text and ``n_near`` those of other texts
    that reach ``t``. Copies are counted per text before anything is joined, so a text that very many records
    have costs one row on each side.
    """
    members = _members(records, record_id, text, split, train, keep)
    e = _side(members, "eval", keep)
    counts = _side(members, "train", []).groupBy("fp_t").agg(F.count("*").alias("k"))
    near = _near(records, members, record_id, text, split, train, n, t).join(counts, "fp_t").groupBy("fp_e").agg(F.sum("k").alias("n_near"))
    classes = e.select("fp_e").distinct()
    linked = classes.join(counts.select(F.col("fp_t").alias("fp_e"), F.col("k").alias("n_copies")), "fp_e", "left").join(near, "fp_e", "left")
    some = linked.where("n_copies is not null or n_near is not null").select("fp_e", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_copies", "n_near")))
    found = e.join(some, "fp_e")
    return found.select("id_eval", *(f"{c}_eval" for c in keep), F.lower(F.hex("fp_e")).alias("class"), "n_copies", "n_near")


def split_overlaps(records: DataFrame, keep: list[str], record_id: str = "id", text: str = "text", split: str = "split", train: str = "train", n: int = SHINGLE_WORDS, t: float = SIMILARITY) -> DataFrame:
    """(id_eval, id_train, similarity, <keep>_eval, <keep>_train): every pair of an evaluation and a training record.

    Records with a null text or split are never in a pair; rows repeated with the same id and text
    count once, under their smallest values of ``keep``; texts of fewer than ``n`` words pair only with equal
    texts, the empty one too. An id that is in both splits pairs with itself.
    """
    members = _members(records, record_id, text, split, train, keep)
    e, f = _side(members, "eval", keep), _side(members, "train", keep)
    near = _near(records, members, record_id, text, split, train, n, t)
    pairs = near.join(e, "fp_e").join(f, "fp_t").drop("fp_e", "fp_t")
    same = e.join(f, F.col("fp_e") == F.col("fp_t")).withColumn("similarity", F.lit(1.0))
    columns = ["id_eval", "id_train", "similarity", *(f"{c}_{s}" for c in keep for s in ("eval", "train"))]
    return pairs.select(columns).unionByName(same.select(columns))


def overlap_report(records: DataFrame, by_eval: list[str], by_train: list[str], record_id: str = "id", text: str = "text", split: str = "split", train: str = "train", n: int = SHINGLE_WORDS, t: float = SIMILARITY) -> DataFrame:
    """(<by_eval>_eval, <by_train>_train, n_pairs, n_eval_records, n_same_words): ``split_overlaps`` counted, without listing its pairs.

    Records of a class with the same values are counted before classes are joined, so the rows follow the number of
    pairs of different texts, however many copies these have.
    """
    keep = list(dict.fromkeys([*by_eval, *by_train]))
    members = _members(records, record_id, text, split, train, keep)
    e, f = _side(members, "eval", by_eval), _side(members, "train", by_train)
    groups_e, groups_t = [f"{c}_eval" for c in by_eval], [f"{c}_train" for c in by_train]
    per_e = e.groupBy("fp_e", *groups_e).agg(F.count("*").alias("k_e"))
    per_t = materialise(f.groupBy("fp_t", *groups_t).agg(F.count("*").alias("k_t")), "p1-counts")
    near = materialise(_near(records, members, record_id, text, split, train, n, t), "p1-near")
    links = near.join(per_t, "fp_t").select("fp_e", *groups_t, "similarity", "k_t").unionByName(per_t.select(F.col("fp_t").alias("fp_e"), *groups_t, F.lit(1.0).alias("similarity"), "k_t"))
    links = links.groupBy("fp_e", *groups_t).agg(F.sum("k_t").alias("k_t"), F.sum(F.when(F.col("similarity") == 1, F.col("k_t")).otherwise(0)).alias("k_same"))
    pairs = per_e.join(links, "fp_e").groupBy(*groups_e, *groups_t).agg(F.sum(F.col("k_e") * F.col("k_t")).alias("n_pairs"), F.sum(F.col("k_e") * F.col("k_same")).alias("n_same_words"))
    # an id may have several texts
    concerned = e.join(links.select("fp_e", *groups_t), "fp_e").select("id_eval", *groups_e, *groups_t).distinct()
    n_ids = concerned.groupBy(*groups_e, *groups_t).agg(F.count("*").alias("n_eval_records"))
    same = F.lit(True)
    for c in (*groups_e, *groups_t):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    renamed = n_ids.withColumnsRenamed({c: f"__{c}" for c in (*groups_e, *groups_t)})
    return pairs.join(renamed, same).select(*groups_e, *groups_t, "n_pairs", "n_eval_records", "n_same_words")
