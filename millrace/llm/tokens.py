"""Problem 4: token counts per document under an existing byte-level BPE tokenizer.

Distinct pre-split pieces are held as arrays of symbols, all pieces of a batch end to end. Each round
joins every adjacent pair with the merge ranks (a sorted key column), takes the lowest rank of each
piece, and merges that pair wherever it stands in the piece, left to right; pieces without a
mergeable pair are done. The rounds end when no piece is left, so their number is the longest chain
of merges in one piece, not the number of merges in the table.

The pieces are distinct within a task, with counts kept from batch to batch in a bounded memory, so
counting needs no shuffle: a piece table of the whole corpus would have to be joined back to every
occurrence. Only the totals per slice are shuffled, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_partition
from ..functions.presplit import pieces

#: Pieces whose counts a worker remembers, and the longest such piece; others are encoded again.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Symbols encoded at a time, and the merge rules a broadcast table may hold.
CHUNK_SYMBOLS, MAX_MERGES = 4_000_000, 4_000_000


class MergeTable:
    """The merge rules as sorted arrays: pair key, rank, new symbol."""

    def __init__(self, rules: list[tuple[int, int, int, int]]) -> None:
        rank, left, right, new = (np.array(x, np.int64) for x in (zip(*rules) if rules else [[]] * 4))
        key = (left << 32) | right
        order = np.lexsort((rank, key))
        key, first = np.unique(key[order], return_index=True)
        self.key, self.rank, self.new = key, rank[order][first], new[order][first]

    def counts(self, values: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        out = np.zeros(len(values), np.int64)
        sizes = np.array([len(v) for v in values], np.int64)
        group = np.cumsum(sizes) // CHUNK_SYMBOLS
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            out[at] = self._counts([values[i] for i in at], sizes[at])
        return out

    def _counts(self, values: list[bytes], sizes: np.ndarray) -> np.ndarray:
        symbols = np.frombuffer(b"".join(values), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(values)), sizes)
        total = sizes.copy()
        none = np.int64(1) << 62
        while len(symbols) > 1 and len(self.key):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], none)
            best = np.full(len(values), none)
            np.minimum.at(best, owner[:-1], rank)
            live = best[owner] < none
            if not live.any():
                break
            hit = (rank == best[owner[:-1]]) & (rank < none)
            # of overlapping hits (equal symbols in a row) every second one counts, from the left
            where = np.flatnonzero(hit)
            start = np.r_[True, np.diff(where) > 1]
            run = np.maximum.accumulate(np.where(start, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.new[at[where]]
            np.subtract.at(total, owner[where], 1)
            live[where + 1] = False
            symbols, owner = symbols[live], owner[live]
        return total


def read_merges(merges: DataFrame, limit: int = MAX_MERGES) -> MergeTable:
    """The rules of a (merge_no, left_id, right_id, new_id) table, which must hold at most ``limit`` rows."""
    rows = [tuple(r) for r in merges.select("merge_no", "left_id", "right_id", "new_id").limit(limit + 1).toLocalIterator()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} merge rules")
    return MergeTable(rows)


def token_counts(docs: DataFrame, merges: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens``: the tokens of each text, special tokens not parsed or added.

    Null texts give no row, empty texts 0 tokens, repeated rows repeated rows. Half surrogates can't
    occur in a Spark string.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(merges))
    source = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text"), *keep)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            split = [pieces(t) for t in texts]
            fresh = list(set().union(*split) - known.keys())
            known.update(zip(fresh, shared.value.counts([p.encode() for p in fresh]).tolist()))
            get = known.__getitem__
            totals = [sum(map(get, doc)) for doc in split]
            yield {c: batch.column(i + 1) for i, c in enumerate(keep)} | {"n_tokens": totals}
            for p in fresh:
                if len(p) > REMEMBERED_CHARS:
                    del known[p]
            if len(known) > REMEMBERED:
                known.clear()

    return map_partition(source, count, schema)


def token_totals(counted: DataFrame, by: list[str]) -> DataFrame:
    """Documents and tokens per slice, and the same for each column of ``by`` alone and in all.

    ``slice`` names the grouping; columns it leaves out are null. Null values of a column are a slice.
    """
    sets = [by, *([c] for c in by), []]
    return (
        counted.groupingSets([[F.col(c) for c in s] for s in sets], *by)
        .agg(
            F.grouping_id().alias("__g"),
            F.count("*").alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
        )
        .withColumn("slice", _names(by))
        .select("slice", *by, "n_docs", "n_tokens")
    )


def _names(by: list[str]):
    top = len(by) - 1
    out = F.lit("all")
    for i, c in enumerate(by):
        alone = sum(1 << (top - j) for j in range(len(by)) if j != i)
        out = F.when(F.col("__g") == alone, F.lit(c)).otherwise(out)
    return F.when(F.col("__g") == 0, F.lit(" x ".join(by))).otherwise(out)
