"""N-gram Jaccard join in a metric space: pivots, Voronoi regions, triangle-inequality windows, recursion, exact leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.graph import components
from plumbline.operators.joins import join_unique
from plumbline.workspace import store

#: Shingles of one bucket of the first dealing (fewer buckets repeat the names of documents less), and of one batch of leaves.
BUCKET_SHINGLES, LEAF_SHINGLES = 2_500_000, 500_000
#: Documents of a region that is joined within one task, pivots of a larger one, and documents of a block of it.
LEAF_DOCUMENTS, PIVOTS, BLOCK = 512, 16, 512
#: Characters of text that are dealt at once.
PART_CHARS = 6_000_000
#: A shingle that so many different texts of one part of a batch hold is counted there, and not sent on with each of them.
HEAVY = 32
#: Windows that replicate a region's documents more often than this do not part it.
SPREAD = 3


def shingle_sets(texts: list, words: int) -> list:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    out = []
    for t in texts:
        split = (t or "").encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
        shingles = map(b" ".join, zip(*(split[i:] for i in range(words)))) if len(split) >= words else [b" ".join(split)] if split else []
        out.append(np.unique(np.fromiter(map(xxh3_64_intdigest, shingles), np.uint64)))
    return out


def class_of(shingles) -> int | None:
    """The name of a set: 63 bits of the hash of its hashes; None without shingles."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(shingles.tobytes()) >> 1 if len(shingles) else None


def classes_of(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and class (of documents with equal sets; null without shingles)."""

    def batch_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(class_of, sets), pa.int64())], names=[key, "n_shingles", "class"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType())])
    return docs.select(key, text).mapInArrow(batch_of, schema)


def least_overlap(n, percent: int):
    """Shingles that a set of n shares with any set linked to it, at least: percent of the union, which is no smaller."""
    return -(-n * percent // 100)


def _packed(names) -> bytes:
    """Names of shingles, the upper 48 bits of their hashes, in six bytes each."""
    import numpy as np

    return np.ascontiguousarray(names.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes):
    import numpy as np

    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


DEALT = "side int, bucket int, owners binary, shingles binary, counts binary"


def _parts(texts: list) -> Iterator[list]:
    """The texts in runs of PART_CHARS characters or a single longer one."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        own = len(t or "")
        if i > start and n + own > PART_CHARS:
            yield texts[start:i]
            start, n = i, 0
        n += own
    yield texts[start:]


def _deal(docs: DataFrame, words: int, buckets: int, text: str) -> DataFrame:
    """The shingles of every class, dealt to buckets by hash.

    A part of a batch gives a row for each bucket: owners (classes) and shingles. Of a shingle that HEAVY classes of the part or more
    hold, the bucket gets only a mark (owner -1), and the classes themselves (side 1, by class) are told that they have it. Counts (the
    class's shingles, times 256, and how many of them share another's name) go to each class once (side 2, by class).
    """

    def batch_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in (p for batch in batches for p in _parts(batch.column(0).to_pylist())):
            found = {c: s for s in shingle_sets(part, words) if (c := class_of(s)) is not None}
            if not found:
                continue
            names = [np.unique(s >> np.uint64(16)) for s in found.values()]
            classes = np.fromiter(found, np.int64)
            owners = np.repeat(classes, [len(s) for s in names])
            counts = np.asarray([len(s) * 256 + min(255, len(s) - len(own)) for s, own in zip(found.values(), names)], np.int64)
            shingles = np.concatenate(names)
            distinct, inverse, n = np.unique(shingles, return_inverse=True, return_counts=True)
            heavy = n[inverse] >= HEAVY
            marks = distinct[n >= HEAVY]
            parts = [
                (0, np.concatenate([owners[~heavy], np.full(len(marks), -1)]), np.concatenate([shingles[~heavy], marks]), None),
                (1, owners[heavy], shingles[heavy], None),
                (2, classes, None, counts),
            ]
            rows: list[list] = [[], [], [], [], []]
            for side, o, s, t in parts:
                at = (o if side else s.astype(np.int64)) % buckets
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[b] : cuts[b + 1]]
                    for column, value in zip(rows, (side, b, o[own].tobytes(), None if s is None else _packed(s[own]), None if t is None else t[own].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[2:]]], names=["side", "bucket", "owners", "shingles", "counts"])

    return docs.select(text).mapInArrow(batch_of, DEALT)


def _joined(pdf, column: str, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(pdf[column]), kind)


def _shared(dealt: DataFrame, buckets: int) -> DataFrame:
    """What classes share, dealt to buckets by class: owners, shingles and numbers of holders (heavy: 2**31 - 1); and their counts."""

    def count(pdf):
        import numpy as np
        import pandas as pd

        side, owners = pdf["side"].iloc[0], _joined(pdf, "owners", "<i8")
        if side == 2:
            owners, at = np.unique(owners, return_index=True)
            return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "owners": [owners.tobytes()], "shingles": [None], "counts": [_joined(pdf, "counts", "<i8")[at].tobytes()], "holders": [None]})
        shingles = _unpacked(b"".join(pdf["shingles"]))
        if side == 1:
            holders = np.full(len(owners), 2**31 - 1, np.int32)
        else:
            order = np.lexsort((owners, shingles))
            owners, shingles = owners[order], shingles[order]
            first = np.ones(len(owners), bool)
            first[1:] = (owners[1:] != owners[:-1]) | (shingles[1:] != shingles[:-1])
            owners, shingles = owners[first], shingles[first]  # a class may come from several batches
            _, at, n = np.unique(shingles, return_index=True, return_counts=True)
            marked = owners[at] == -1
            holders = np.repeat(np.where(marked, 2**31 - 1, n), n).astype(np.int32)
            keep = (holders > 1) & (owners >= 0)
            owners, shingles, holders = owners[keep], shingles[keep], holders[keep]
        to = owners % buckets
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts)).tolist()
        cut = lambda values, packed=bytes: [packed(values[order[cuts[b] : cuts[b + 1]]]) for b in used]
        return pd.DataFrame({"bucket": np.asarray(used, np.int32), "owners": cut(owners), "shingles": cut(shingles, _packed), "counts": None, "holders": cut(holders)})

    return dealt.groupBy("side", "bucket").applyInPandas(count, "bucket int, owners binary, shingles binary, counts binary, holders binary")


def open_classes(shared: DataFrame, percent: int) -> DataFrame:
    """(id, n, s, cells) of the classes that may have links: n is the size of the set, s has the shingles that other classes
    hold too (all that overlaps are made of), cells the first few of these, rarest first.

    The sets {x} of one shingle are the pivots of the first division: a set is nearest to those of its own shingles, and of
    these the rarest names its cell. A set linked to it lacks few of its shingles (`least_overlap`), so it lies in the cell of
    one of the first so many, and the set is replicated to those. Shingles that no other class holds come first and need no
    cell: where they fill the window, a set has no links.
    """

    def first(pdf):
        import numpy as np
        import pandas as pd

        told = pdf[pdf["counts"].notna()]
        classes, at = np.unique(_joined(told, "owners", "<i8"), return_index=True)
        counts = _joined(told, "counts", "<i8")[at]
        pdf = pdf[pdf["counts"].isna()]
        owners, shingles, holders = _joined(pdf, "owners", "<i8"), _unpacked(b"".join(pdf["shingles"])), _joined(pdf, "holders", "<i4")
        # a shingle may be told twice, by its bucket and by a batch: then it is heavy
        order = np.lexsort((-holders.astype(np.int64), shingles, owners))
        owners, shingles, holders = owners[order], shingles[order], holders[order]
        keep = np.ones(len(owners), bool)
        keep[1:] = (owners[1:] != owners[:-1]) | (shingles[1:] != shingles[:-1])
        owners, shingles, holders = owners[keep], shingles[keep], holders[keep]
        order = np.lexsort((shingles, holders, owners))
        owners, shingles = owners[order], shingles[order]
        ids, at, held = np.unique(owners, return_index=True, return_counts=True)
        own = counts[np.searchsorted(classes, ids)]
        n, met = own >> 8, own & 255
        room = n - least_overlap(n, percent) + 1 - (n - met - held)  # what shingles of its own leave of the window
        rows = np.flatnonzero(room > 0).tolist()
        cut = lambda i, k: shingles[at[i] : at[i] + k]
        return pd.DataFrame({"id": owners[at[rows]], "n": n[rows], "s": pd.Series([_packed(cut(i, held[i])) for i in rows], dtype=object), "cells": pd.Series([cut(i, min(room[i], held[i])).astype(np.int64) for i in rows], dtype=object)})

    return shared.groupBy("bucket").applyInPandas(first, "id long, n long, s binary, cells array<bigint>")


def regioned(docs: DataFrame, stored: DataFrame, words: int, percent: int, text: str, areas: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, region, n, s, fp) of the classes that share a cell with another: cells with a class in common form one region, so
    no link leaves a region. `areas` may give, for the ids of the classes that can have links, (id, fp, area): then
    cells hold only classes of one area. Stored."""
    total = stored.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_SHINGLES)
    sets = store(open_classes(_shared(_deal(docs, words, buckets, text), buckets), percent), "jaccard-sets")
    if areas:
        placed = areas(sets.select("id")).withColumnRenamed("id", "_id")
        sets = store(sets.join(placed, F.col("id") == F.col("_id")).drop("_id"), "jaccard-placed")
    else:
        sets = sets.withColumns({"fp": F.lit(0).cast("long"), "area": F.lit(0)})
    cells = sets.select("id", "area", F.explode("cells").alias("cell")).select("id", F.xxhash64("area", "cell").alias("cell"))
    held = store(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "jaccard-cells")
    # a cell is a star around its first class: as many links as entries
    stars = join_unique(cells, held.where("n > 1").select("cell", "first"), ["cell"], held)
    found = store(components(stars.select(F.col("id").alias("a"), F.col("first").alias("b"))), "jaccard-candidates")
    least = found.select(F.col("component").alias("id"), "component").distinct()  # the least of a group is not in its rows
    regions = store(found.unionByName(least), "jaccard-regions").select(F.col("id").alias("_id"), F.col("component").alias("region"))
    return store(sets.join(regions, F.col("id") == F.col("_id")).select("id", "region", "n", "s", "fp"), "jaccard-members")


class Overlaps:
    """Sets one after another, as numbers of a joint vocabulary; `of(i)` has what each shares with set i."""

    def __init__(self, sets: list):
        import numpy as np

        held = np.fromiter(map(len, sets), np.int64)
        self.ends = np.cumsum(held)
        self.starts = self.ends - held
        vocabulary, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(vocabulary), np.int32)

    def of(self, i: int):
        import numpy as np

        own = self.numbers[self.starts[i] : self.ends[i]]
        self.mark[own] = 1
        shared = np.add.reduceat(self.mark[self.numbers], self.starts)
        self.mark[own] = 0
        return shared


def _near(prints, i: int, radius: int):
    import numpy as np

    return np.bitwise_count(prints ^ prints[i]) <= radius


def links_within(ids, labels, sizes, sets: list, percent: int, few: int | None = None, prints=None, radius: int = 64) -> list[tuple]:
    """Links (a, b) that join what can be joined among these sets (with `few`, pairs of one of the first so many): every pair
    with different labels is compared, unless links found before have joined the two. `sizes` are those of the whole sets,
    of which `sets`, none empty, may lack what no other holds. Distances to the first set leave out pairs that the triangle
    inequality keeps apart. With `prints`, the fingerprints of a pair differ in at most `radius` bits too."""
    import numpy as np

    overlaps, sizes = Overlaps(sets), np.asarray(sizes, np.int64)
    _, root = np.unique(labels, return_inverse=True)
    links, pivot = [], None
    for i in range(min(len(ids) - 1, few if few is not None else len(ids))):
        apart = root != root[i]
        if radius < 64:
            apart &= _near(prints, i, radius)
        open_ones = np.flatnonzero(apart[i + 1 :]) + i + 1
        if pivot is not None and open_ones.size:
            open_ones = open_ones[np.abs(pivot[open_ones] - pivot[i]) <= 1 - percent / 100 + 1e-9]
        if not open_ones.size:
            continue
        shared = overlaps.of(i)
        either = sizes + sizes[i] - shared
        if pivot is None:
            pivot = 1 - shared / either
        for j in open_ones[100 * shared[open_ones] >= percent * either[open_ones]].tolist():
            if root[j] != root[i]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def _frame(links: list):
    import numpy as np
    import pandas as pd

    pairs = np.asarray(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _leaves(members: DataFrame, percent: int, radius: int, batches: int) -> DataFrame:
    """Links within regions (region, id, label, n, s, fp) that each fit a task, many regions to a task."""

    def join(pdf):
        import numpy as np

        links = []
        for _, own in pdf.groupby("region"):
            links += links_within(own["id"].to_numpy(), own["label"].to_numpy(), own["n"], list(map(_unpacked, own["s"])), percent, None, own["fp"].to_numpy().view(np.uint64), radius)
        return _frame(links)

    return members.withColumn("_batch", F.pmod(F.xxhash64("region"), F.lit(batches))).groupBy("_batch").applyInPandas(join, "a long, b long")


def _distances(members: DataFrame, pivots: int, block: int, sizes: DataFrame, radius: int) -> DataFrame:
    """Of regions larger than a leaf: (region, id, pivots with distances). Pivots are the ids of least hash in as many parts
    of the region; documents go in blocks, to each of which the pivots are sent."""
    salt = F.pmod(F.xxhash64("id", F.lit(1), "region"), F.lit(pivots))
    chosen = store(members.groupBy("region", salt.alias("_salt")).agg(F.min_by(F.struct("id", "n", "s", "fp"), F.xxhash64("id", F.lit(2))).alias("p")), "jaccard-pivots")
    blocks = sizes.select("region", F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    own = join_unique(members, blocks, ["region"], sizes).withColumn("_block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_blocks")).cast("int"))
    sent = chosen.join(blocks, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "p.id", "p.n", "p.s", "p.fp")
    both = own.select("region", "_block", "id", "n", "s", "fp", F.lit(False).alias("is_pivot")).unionByName(sent.withColumn("is_pivot", F.lit(True)))

    def measure(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        at = pdf[pdf["is_pivot"]]
        rows = pdf[~pdf["is_pivot"]]
        if not len(rows):
            return pd.DataFrame({"region": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
        overlaps, sizes_ = Overlaps([*map(_unpacked, rows["s"]), *map(_unpacked, at["s"])]), np.concatenate([rows["n"], at["n"]])
        columns = []
        for k in range(len(rows), len(rows) + len(at)):
            shared = overlaps.of(k)
            columns.append((1 - shared / (sizes_ + sizes_[k] - shared))[: len(rows)])
        table = np.stack(columns, 1)
        ids = at["id"].tolist()
        apart = np.stack([np.bitwise_count(rows["fp"].to_numpy().view(np.uint64) ^ p) > radius for p in at["fp"].to_numpy().view(np.uint64)], 1)
        near = [[{"pivot": p, "d": float(d), "apart": bool(a)} for p, d, a in zip(ids, line, far)] for line, far in zip(table, apart)]
        return pd.DataFrame({"region": rows["region"], "id": rows["id"], "near": near})

    return both.groupBy("region", "_block").applyInPandas(measure, "region long, id long, near array<struct<pivot:long,d:double,apart:boolean>>")


def jaccard_links(members: DataFrame, percent: int = 85, leaf: int = LEAF_DOCUMENTS, leaf_shingles: int = LEAF_SHINGLES, pivots: int = PIVOTS, block: int = BLOCK, most_levels: int = 12, radius: int = 64) -> DataFrame:
    """Links (a, b) between sets (id, region, n, s, fp) of one region, with the components of all pairs that share at least `percent`
    of their union. Every link is such a pair. With a `radius` below 64, fingerprints of a pair must be that near too.

    Regions that fit a leaf are joined there. Larger ones are divided: the distances to their pivots link what is that near to
    one; what that joins is one label. A region with one label is done. Others fall into the Voronoi regions of their
    pivots, each document also going where the triangle inequality lets a partner be (no farther than its own pivot by
    twice the radius of a link, nor than the region's reach by that radius), and each region is treated in the same way.
    Where windows replicate too much, as distances differ too little to divide, the documents outside the region's
    largest label are compared with all of the region, block against block.
    """
    theta = 1 - percent / 100 + 1e-9
    found: list[DataFrame] = []
    members = members.withColumn("label", F.col("id"))
    for _ in range(most_levels):
        sizes = store(members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("s") / 6).cast("long").alias("shingles"), F.count_distinct("label").alias("labels")), "jaccard-sizes")
        is_leaf = (F.col("n") <= leaf) & (F.col("shingles") <= leaf_shingles) | (F.col("n") <= 2)
        leaves = sizes.where((F.col("labels") > 1) & is_leaf)
        total = leaves.agg(F.sum("shingles")).first()[0] or 0
        if total:
            small = join_unique(members, leaves.select("region"), ["region"], sizes)
            found.append(store(_leaves(small, percent, radius, max(1, total // leaf_shingles, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "jaccard-leaf-links"))
        big = store(sizes.where((F.col("labels") > 1) & ~is_leaf), "jaccard-big")
        if big.isEmpty():
            break
        large = store(join_unique(members, big.select("region"), ["region"], sizes), "jaccard-large")
        near = store(_distances(large, pivots, block, big, radius), "jaccard-near")
        flat = near.select("region", "id", F.explode("near").alias("p")).select("region", "id", "p.pivot", "p.d", "p.apart")
        found.append(store(flat.where((F.col("d") <= theta) & ~F.col("apart") & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b")), "jaccard-pivot-links"))
        joined = store(components(_union(found)), "jaccard-labels")
        named = store(large.drop("label").join(joined.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("region", "id", "n", "s", "fp", F.coalesce("component", "id").alias("label")), "jaccard-named")
        open_ones = named.groupBy("region").agg(F.count_distinct("label").alias("left")).where("left > 1").select("region")
        big = store(big.join(open_ones, "region", "left_semi"), "jaccard-open")
        if big.isEmpty():
            break
        # the Voronoi regions, and the windows into others
        own = F.array_min(F.transform("near", lambda p: F.struct(p["d"], p["pivot"])))
        placed = near.join(big.select(F.col("region").alias("_r")), F.col("region") == F.col("_r"), "left_semi").select("region", "id", own.alias("own"), F.explode("near").alias("p")).select("region", "id", "p.pivot", "p.d", F.col("own.d").alias("own_d"), (F.col("own.pivot") == F.col("p.pivot")).alias("native"))
        reach = placed.where("native").groupBy("region", "pivot").agg(F.max("d").alias("reach"))
        windows = placed.where(F.col("d") <= F.col("own_d") + 2 * theta).join(reach, ["region", "pivot"]).where(F.col("native") | (F.col("d") <= F.col("reach") + theta))
        into = store(windows.select("region", "id", F.xxhash64("region", "pivot").alias("part")), "jaccard-windows")
        spread = into.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("part").alias("parts"))
        held = into.groupBy("region", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max("k").alias("most"))
        parted = store(big.join(spread, "region").join(held, "region").select("region", "n", ((F.col("m") <= SPREAD * F.col("n")) & (F.col("most") <= 0.75 * F.col("n"))).alias("parts_well")), "jaccard-parted")
        dense = join_unique(named, parted.where(~F.col("parts_well")).select("region"), ["region"], big)
        if not parted.where(~F.col("parts_well")).isEmpty():
            found.append(store(_block_links(store(dense, "jaccard-dense"), percent, block, radius), "jaccard-block-links"))
        if parted.where("parts_well").isEmpty():
            break
        moved = into.join(parted.where("parts_well").select(F.col("region").alias("_r")), F.col("region") == F.col("_r")).select("region", "id", "part")
        members = store(moved.join(named, ["region", "id"]).select(F.col("part").alias("region"), "id", "n", "s", "fp", "label"), "jaccard-parts")
    else:
        raise RuntimeError(f"regions did not become small in {most_levels} levels")
    return _union(found) if found else members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block_links(members: DataFrame, percent: int, block: int, radius: int) -> DataFrame:
    """Links between the documents outside a region's largest label and all others of the region: both sides are dealt to
    blocks, and each pair of blocks is one task's work."""
    counts = members.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    main = store(counts.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")), "jaccard-main")
    facts = main.select("region", "main", F.ceil(F.col("all") / block).cast("int").alias("_all"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("_few"))
    dealt = join_unique(members, facts, ["region"], main.select("region", F.col("all").alias("n")))
    draw = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.col(n), F.lit(1))).cast("int")
    few = dealt.where("label <> main").select("region", "id", "label", "n", "s", "fp", draw(4, "_few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("j"), F.lit(True).alias("side"))
    all_ = dealt.where("_few > 0").select("region", "id", "label", "n", "s", "fp", F.explode(F.sequence(F.lit(0), F.col("_few") - 1)).alias("i"), draw(5, "_all").alias("j"), F.lit(False).alias("side"))

    def compare(pdf):
        import numpy as np
        import pandas as pd

        few, rest = pdf[pdf["side"]], pdf[~pdf["side"]]
        if not len(few) or not len(rest):
            return _frame([])
        both = pd.concat([few, rest])
        return _frame(links_within(both["id"].to_numpy(), both["label"].to_numpy(), both["n"], list(map(_unpacked, both["s"])), percent, len(few), both["fp"].to_numpy().view(np.uint64), radius))

    return few.unionByName(all_).groupBy("region", "i", "j").applyInPandas(compare, "a long, b long")


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id", leaf: int = LEAF_DOCUMENTS, leaf_shingles: int = LEAF_SHINGLES, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per document: key, n_shingles (distinct shingles of `words` words), component_id (smallest key reachable over links,
    itself included). Two documents are linked if their sets share at least `percent` of their union.

    Texts are lower-cased (A-Z only); words are runs between ASCII white space; a text with fewer words than a shingle has
    its whole sequence as one. Null and empty texts, and texts of white space, have no shingles and no links. Repeated rows
    keep a row each. A null key is carried, but never names a component unless it is alone in it (component_id null then).
    No rows give no rows; other columns are not read.

    Equal sets form a class first, and classes are joined (regioned, jaccard_links). Shingles are
    counted by 64-bit hashes and compared by 48 bits of them.
    """
    stored = store(classes_of(docs, words, text, key), "jaccard-classes")
    found = components(jaccard_links(regioned(docs, stored, words, percent, text), percent, leaf, leaf_shingles, pivots, block))
    linked = grouped(stored.where("class is not null"), found, key).select(key, "n_shingles", "component_id")
    return linked.unionByName(stored.where("class is null").select(key, "n_shingles", F.col(key).alias("component_id")))


def grouped(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Stored rows with component_id: the least key of their class's component in `found` (id, component). Rows without a
    class are one class of their own."""
    rows = stored.withColumn("class", F.coalesce("class", F.lit(-1)))
    classes = store(rows.groupBy("class").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")), "jaccard-reps")
    named = store(classes.join(found, F.col("class") == F.col("id"), "left").select("class", "rep", F.coalesce("component", "class").alias("component")), "jaccard-components")
    least = store(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "jaccard-least")
    of = store(join_unique(named, least.select("component", "component_id"), ["component"], least).select("class", "component_id"), "jaccard-of")
    return join_unique(rows, of, ["class"], classes)
