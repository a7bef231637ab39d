"""Problem 5: splitting oversized texts at natural boundaries with overlap, by pointer doubling.

For every boundary of a text the farthest legal successor is found at once: a piece that starts with
the overlap before the boundary may end at most ``limit`` bytes after that start. Among the ends in
reach the best kind wins: the last paragraph end, else line end, else sentence end, if it leaves the
piece at least half full; else the last word end; else the last of any of these ends, however early; else the last whole
character. The successor table
is then squared again and again while the set of reached boundaries grows by its image, so all cuts of
the greedy division come out after a logarithmic number of rounds instead of one after the other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_batches

LIMIT_BYTES, OVERLAP_BYTES = 2000, 200
#: Share of a piece that an end of a better kind than a word end must fill.
LEAST_FILL = 0.5

KINDS = ("paragraph", "line", "sentence", "word", "character")
_ENDS = (
    re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*"),
    re.compile(r"\s+"),
)
#: Marks that belong to the character before them.
_JOINED = re.compile("[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")


def cut_points(text: str, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int, int, str]]:
    """The pieces of ``text``: (first byte, first new byte, end byte, kind of the end). One piece if it fits.

    ``overlap`` must be below half of ``limit`` and ``limit`` at least 16, so that every piece brings new text.
    """
    if limit < 16 or not 0 <= overlap < limit / 2:
        raise ValueError("limit must be at least 16 and overlap under half of it")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    # 32-bit offsets: a Spark string is shorter than 2^31 bytes
    width = (1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)
    offset = np.zeros(n + 1, np.int32)  # byte offset of each character boundary
    np.cumsum(width, out=offset[1:])
    del points, width
    if offset[-1] <= limit:
        return [(0, 0, int(offset[-1]), "end")]

    joined = np.zeros(n + 1, bool)
    for m in _JOINED.finditer(text):
        joined[m.start()] = True
        joined[m.end()] |= m.group() == "‍"
    whole = np.flatnonzero(~joined)
    if len(whole) < 2 or np.diff(offset[whole]).max() > limit // 4:
        whole = np.arange(n + 1)  # a tower of marks: whole code points must do
    ends = [np.array([m.end() for m in e.finditer(text)], np.int32) for e in _ENDS]
    ends = [e[~joined[e]] for e in ends]
    ends[0] = np.union1d(ends[0], [n])  # the end of the text is as good an end as any

    # where the piece after each boundary starts: at a word in the last ``overlap`` bytes, else at a character
    earliest = np.searchsorted(offset, offset - overlap).astype(np.int32)
    nodes = np.arange(n + 1, dtype=np.int32)

    def next_of(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(marks, at)
        return np.r_[marks, n + 1].astype(np.int32)[k]

    start = next_of(ends[3], earliest)
    start = np.where((start < nodes) & (earliest > 0), start, next_of(whole, earliest))
    start = np.where(earliest == 0, 0, np.minimum(start, nodes))
    start[0] = 0

    # the farthest legal successor of every boundary
    reach = (np.searchsorted(offset, offset[start] + limit, side="right") - 1).astype(np.int32)
    least = offset[start] + int(limit * LEAST_FILL)
    successor = np.full(n + 1, -1, np.int32)
    kind = np.full(n + 1, 4, np.int8)
    far = {}
    for level, marks in enumerate((*ends, whole)):
        k = np.searchsorted(marks, reach, side="right") - 1
        far[level] = to = np.r_[marks, -1].astype(np.int32)[k]  # index -1 is the -1
        if level == 4:  # an early end of a better kind before a cut inside a word
            for early in range(3):
                ok = (successor < 0) & (far[early] > nodes) & (far[early] == np.maximum.reduce([far[i] for i in range(3)]))
                successor[ok], kind[ok] = far[early][ok], early
        ok = (successor < 0) & (to > nodes) & ((to == n) | (level > 2) | (offset[np.maximum(to, 0)] >= least))
        successor[ok], kind[ok] = to[ok], level
    short = successor < 0  # only inside a tower of marks that cuts never reach, and at the end itself
    successor[short] = np.minimum(np.maximum(reach, nodes + 1), n)[short]

    reached = np.zeros(n + 1, bool)
    reached[0] = True
    jump = successor.copy()
    while True:  # after r rounds the first 2^r cuts are reached
        more = np.zeros(n + 1, bool)
        more[jump[np.flatnonzero(reached)]] = True
        if not (more & ~reached).any():
            break
        reached |= more
        jump = jump[jump]
    cuts = np.flatnonzero(reached)
    return [
        (int(offset[start[a]]), int(offset[a]), int(offset[b]), "end" if b == n else KINDS[kind[a]])
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def split_texts(df: DataFrame, keep: list[str], text: str, limit: int = LIMIT_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """The columns ``keep`` and piece_no, n_pieces, start, new_from, end, cut, piece of each text above ``limit`` bytes.

    ``start`` and ``end`` are byte offsets of the piece in the text, ``new_from`` where its overlap
    ends; the slices ``new_from:end`` joined give the text again. Null texts and texts within the
    limit give no rows; repeated rows give repeated rows. Column names are free: the inputs are
    renamed inside.
    """
    source = df.where(F.octet_length(F.col(text)) > limit).select(F.col(text).alias("__text"), *keep)
    fields = ["piece_no int", "n_pieces int", "start bigint", "new_from bigint", "end bigint", "cut string", "piece string"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + fields)

    def run(batch: pa.RecordBatch) -> dict | None:
        rows, owner = [], []
        for i, t in enumerate(batch.column(0).to_pylist()):
            raw = t.encode()
            got = cut_points(t, limit, overlap)
            owner += [i] * len(got)
            rows += [(k, len(got), s, f, e, c, raw[s:e].decode()) for k, (s, f, e, c) in enumerate(got)]
        if not rows:
            return None
        at = pa.array(owner)
        return {c: batch.column(j + 1).take(at) for j, c in enumerate(keep)} | dict(zip((f.split()[0] for f in fields), zip(*rows)))

    return map_batches(source, run, schema)


def messages(conversations: DataFrame, conv_id: str = "conv_id", column: str = "messages") -> DataFrame:
    """(conv_id, msg_idx, role, content) of every message, redelivered conversations once each row."""
    return conversations.select(F.col(conv_id).alias("conv_id"), F.posexplode(F.col(column)).alias("msg_idx", "m")).select(
        "conv_id", "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )
