"""Problem 7: filling containers of fixed capacity by multiway differencing.

Items are first cut where one alone exceeds the capacity. Full parts are containers already, however many an item has; they are numbered
and need no packing. All other parts, at most one of an item, are spread by a hash of their id
over groups of about ``GROUP_ITEMS``, whatever their number, so that no task grows with the data
and neither a source nor an item can make a group hot. Each group is packed on its own:

* Karmarkar-Karp: every item is a partial partition of ``k`` windows; the two partial partitions with
  the largest imbalance are merged, the fullest windows of one with the emptiest of the other, until
  one is left. Items the size of the capacity are containers already and stay out.
* ``k`` starts at the lower bound (the sum over the capacity, or the number of items above half), so
  the windows are near-equal and near-full, some of them a little above the capacity. These exchange
  an item with a window that has room for the difference; where none has, they give up an item.
* Items given up without room elsewhere raise the window count; the smallest count found is kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship

CAPACITY = 1024
#: Items a group holds on average. The unused end of a group is a fraction of one container.
GROUP_ITEMS = 1500
#: Groups a task packs, about half a second's work.
GROUPS_A_TASK = 8
#: Candidates looked at for one exchange between windows, and passes over the windows.
SWAP_TRIES, SWAP_ROUNDS = 200, 6
#: Window counts tried in a row without a better result.
PATIENCE = 6


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` windows of near-equal sums; the items' indices in each."""
    heap = []
    for i, s in enumerate(sizes):
        # only the non-empty windows are held, smallest sum first; the rest are empty
        heap.append((-s, i, [(s, [i])]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = k - len(a)
        if len(b) <= spare:
            merged = a + b
        else:
            # the emptiest windows of a take the fullest of b: b's smallest go to a's empty windows
            rest = len(b) - spare
            merged = b[:spare] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[:rest], reversed(b[spare:]))] + a[rest:]
        merged.sort(key=lambda w: w[0])
        base = merged[0][0] if len(merged) == k else 0
        if base:  # equal parts of all windows don't count for the imbalance
            heapq.heappush(heap, (base - merged[-1][0], tick, merged))
        else:
            heapq.heappush(heap, (-merged[-1][0], tick, merged))
        tick += 1
    return [w[1] for w in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container number of each item; no item may exceed ``capacity``."""
    out = [-1] * len(sizes)
    n = 0
    open_ = []
    for i, s in enumerate(sizes):
        if s >= capacity:
            out[i] = n
            n += 1
        elif s > 0:
            open_.append(i)
    rest = [sizes[i] for i in open_]
    windows = _fit(rest, capacity) if rest else []
    for w in windows:
        for i in w:
            out[open_[i]] = n
        n += 1
    empty = max(0, n - 1)  # items of size 0 go anywhere
    return [c if c >= 0 else empty for c in out]


def _fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The best of the window counts from the lower bound up, until a higher count can't be better or several weren't."""
    k = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    best: list[list[int]] | None = None
    since = 0
    while best is None or (k < len(best) and since < PATIENCE):
        windows = differencing(sizes, k)
        windows += [[] for _ in range(k - len(windows))]
        _swap(windows, sizes, capacity)
        _settle(windows, sizes, capacity)
        since += 1
        if best is None or len(windows) < len(best):
            best, since = windows, 0
        k += 1
    return [w for w in best if w]


def _swap(windows: list[list[int]], sizes: list[int], capacity: int) -> None:
    """Lower windows above ``capacity`` by exchanging items with windows that have room for the difference."""
    load = [sum(sizes[i] for i in w) for w in windows]
    where = {i: j for j, w in enumerate(windows) for i in w}
    ordered = sorted((sizes[i], i) for i in where)
    for _ in range(SWAP_ROUNDS):
        moved = False
        for j in sorted((j for j, x in enumerate(load) if x > capacity), key=lambda j: -load[j]):
            over, best = load[j] - capacity, None
            for x in windows[j]:
                # the exchange that leaves least room behind, of those that settle this window;
                # else the one that lowers it most
                for least, settles in ((over, True), (1, False)):
                    if not settles and best is not None and best[0]:
                        break
                    at = bisect_left(ordered, (sizes[x] - least + 1, -1)) - 1
                    for size, y in reversed(ordered[max(0, at + 1 - SWAP_TRIES) : at + 1]):
                        h, less = where[y], sizes[x] - size
                        room = capacity - load[h] - less
                        if h == j or room < 0:
                            continue
                        rank = (settles, -room if settles else less)
                        if best is None or rank > best[:2]:
                            best = (*rank, x, y, h, less)
                        if settles:
                            break
            if best is not None:
                x, y, h, less = best[2:]
                windows[j].remove(x)
                windows[h].remove(y)
                windows[j].append(y)
                windows[h].append(x)
                where[x], where[y] = h, j
                load[j] -= less
                load[h] += less
                moved = True
        if not moved:
            break


def _settle(windows: list[list[int]], sizes: list[int], capacity: int) -> None:
    """Take from windows still above ``capacity`` the items that settle it, and open windows for those without room."""
    out: list[int] = []
    load = []
    for w in windows:
        w.sort(key=lambda i: sizes[i])
        total = sum(sizes[i] for i in w)
        while total > capacity:
            at = min(bisect_left([sizes[i] for i in w], total - capacity), len(w) - 1)
            total -= sizes[w[at]]
            out.append(w.pop(at))
        load.append(total)
    room = sorted((capacity - x, j) for j, x in enumerate(load) if x < capacity)
    for i in sorted(out, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            windows.append([])
            left, j = capacity, len(windows) - 1
        else:
            left, j = room.pop(at)
        windows[j].append(i)
        if left > sizes[i]:
            insort(room, (left - sizes[i], j))


def cut_items(items: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(item, part, start, size): items above ``capacity`` cut into full parts and a rest."""
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("s") / capacity).cast("int") - 1)),
        lambda p: F.struct(
            p.alias("part"),
            (p.cast("bigint") * capacity).alias("start"),
            F.least(F.lit(capacity).cast("bigint"), F.col("s") - p.cast("bigint") * capacity).alias("size"),
        ),
    )
    return items.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("s")).where("s is not null").select("item", F.inline(parts))


def pack_items(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, expected: int | None = None) -> DataFrame:
    """(item, part, start, size, grp, container): every item in one container ``(grp, container)``; containers of full parts have negative numbers.

    ``start`` is the offset of a part in its item. ``item`` must be unique; null sizes give no row,
    items of size 0 take no room. ``expected`` is the number of items if known, else they are counted.
    The result is the same for any partitioning and order of the input.
    """
    ship(items.sparkSession)
    total = items.where(F.col(size).isNotNull()).count() if expected is None else expected
    groups = max(1, round(total / group_items))
    parts = cut_items(items, item, size, capacity).withColumn("grp", F.pmod(F.xxhash64(F.col("item").cast("string"), "part"), F.lit(groups)).cast("int"))
    # written, as the sizes may have been counted from texts
    parts = materialise(parts, "p7-parts")
    full = parts.where(F.col("size") >= capacity)
    full = full.withColumn("container", -F.row_number().over(Window.partitionBy("grp").orderBy("item", "part")))
    parts = parts.where(F.col("size") < capacity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item", "part"], ascending=[False, True, True], kind="stable", ignore_index=True)
        pdf["container"] = pack(pdf["size"].tolist(), capacity)
        return pdf

    kind = items.schema[item].dataType.simpleString()
    # the rows are small but the work isn't, so partitions go by the number of groups and aren't merged by size
    packed = parts.repartition(-(-groups // GROUPS_A_TASK), "grp").groupBy("grp").applyInPandas(run, f"item {kind}, part int, start bigint, size bigint, grp int, container int")
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, fullest and emptiest container, least possible containers."""
    loads = packed.groupBy("grp", "container").agg(F.sum("size").alias("load"))
    return loads.agg(
        F.count("*").alias("n_containers"),
        F.sum("load").alias("n_tokens"),
        (1 - F.sum("load") / (F.count("*") * capacity)).alias("unused_share"),
        F.max("load").alias("max_load"),
        F.min("load").alias("min_load"),
        F.ceil(F.sum("load") / capacity).alias("least_containers"),
    )
