"""Sharding into near-equal sizes: a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import numbered
from plumbline.workspace import store

#: Atoms: groups of equal texts, ordered by hash and gathered in so many hash ranges, whatever the size of the table.
ATOMS = 1 << 16


def _greedy(ends: list[int], capacity: int, most: int) -> int:
    """Shards that a greedy pass needs if none may pass `capacity`, save an atom larger than that, which stands alone."""
    at, n = 0, 0
    while at < len(ends) and n <= most:
        at = max(at + 1, bisect_right(ends, (ends[at - 1] if at else 0) + capacity))
        n += 1
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity at which the greedy pass needs at most `shards` shards, by binary search."""
    ends = list(accumulate(sizes))
    low, high = 0, ends[-1] if ends else 0
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _greedy(ends, middle, shards) <= shards else (middle + 1, high)
    return low


def _even(ends: list[int], begin: int, end: int, shards: int, capacity: int) -> list[int]:
    """Where shards of the atoms begin..end-1 start, each cut as near as it can to an even share of what is left, among
    the places from which the rest still fits. ends[i] is the size before atom i."""
    earliest = [end]  # earliest[k]: the first place from which k shards hold all the rest
    for _ in range(shards - 1):
        earliest.append(max(begin, min(earliest[-1] - 1, bisect_left(ends, ends[earliest[-1]] - capacity))))
    starts, at = [begin], begin
    for left in range(shards - 1, 0, -1):
        goal = ends[at] + (ends[end] - ends[at]) / (left + 1)
        near = bisect_left(ends, goal)
        if goal - ends[near - 1] < ends[near] - goal:
            near -= 1
        at = max(at + 1, earliest[left], min(near, bisect_right(ends, ends[at] + capacity) - 1, end - left))
        starts.append(at)
    return starts


def cuts(sizes: list[int], shards: int) -> list[int]:
    """The place of the first atom of each shard but the first, after binary search for the smallest feasible capacity.

    A plain greedy pass at that capacity can leave a shard short where the atoms end, or before one that stands alone.
    So each run of other atoms gets the shards that the pass gives it, shards to spare go to the runs with the fullest
    ones, and each run is then cut evenly within the capacity.
    """
    n, ends = len(sizes), [0, *accumulate(sizes)]
    capacity = smallest_capacity(sizes, shards)
    edges = [-1, *(i for i, size in enumerate(sizes) if size > capacity), n]
    runs = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1]
    given = [_greedy([e - ends[a] for e in ends[a + 1 : b + 1]], capacity, shards) for a, b in runs]
    for _ in range(shards - sum(given) - (len(edges) - 2)):
        fullest = max((i for i, (a, b) in enumerate(runs) if given[i] < b - a), key=lambda i: (ends[runs[i][1]] - ends[runs[i][0]]) / given[i], default=None)
        if fullest is None:
            break
        given[fullest] += 1
    starts = sorted([*edges[1:-1], *(at for (a, b), k in zip(runs, given) for at in _even(ends, a, b, k, capacity))])
    return [*starts[1:], *[n] * (shards - len(starts))][: shards - 1]


def shard(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """Deal documents to shards 0..shards-1 of near-equal size; equal texts stay together.

    A row per document: key, size (UTF-8 bytes of the text plus `overhead`), text_crc32, law ('bytes'), shard, slot
    (gapless from 0 within the shard), grown_shard (null: only a law by key has one). A null text has no bytes and
    stands with the empty texts; null keys and repeated rows are dealt like others; no rows give no rows; other
    columns are not read. The driver holds the sizes of ATOMS hash ranges at most, and the cuts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(key, (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(whole), F.lit(ATOMS)).cast("int").alias("_atom"))
    sized = store(sized, "shard-sizes")
    atoms = sized.groupBy("_atom").agg(F.sum("size").alias("size")).orderBy("_atom").collect()
    first = [atoms[at]["_atom"] if at < len(atoms) else ATOMS for at in cuts([a["size"] for a in atoms], shards)]
    number: Column = F.size(F.filter(F.array(*[F.lit(a) for a in first]), lambda a: a <= F.col("_atom"))) if first else F.lit(0)
    dealt = store(sized.withColumn("shard", number.cast("int")).drop("_atom"), "shard-dealt")
    slots = numbered(dealt, ["shard"], F.struct(key, "text_crc32"), "shard")
    return slots.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
