"""Exact k-means on integers by ball-tree filtering: whole balls go to one centroid where the triangle inequality allows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.workspace import store

#: Points of one tree, and of a leaf in which each point is compared.
TREE_POINTS, LEAF = 4096, 16
#: Entries beyond this, in fixed point, could bring squared distances past a long.
MOST = 1 << 27
TREES = "points binary, nodes array<struct<start:int,stop:int,left:int,right:int,radius:double>>, sums binary"


def fixed_points(rows: DataFrame, vector: str, key: str, size: int, scale: int) -> DataFrame:
    """key and `x` = floor(scale * entry), as longs, of vectors with exactly `size` finite entries."""
    whole = F.coalesce((F.size(vector) == size) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return rows.where(whole).select(key, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def build_tree(points) -> tuple:
    """(order, nodes, sums) of a ball tree over integer points: `order` sorts them so that each node's are neighbours; a node
    is (start, stop, left, right, radius), parents first, children -1 in leaves; sums has each node's integer sum."""
    import numpy as np

    order, nodes, sums = np.arange(len(points)), [], []
    open_nodes = [(0, len(points), -1, 0)]
    while open_nodes:
        start, stop, parent, side = open_nodes.pop()
        own = points[order[start:stop]]
        total = own.sum(0)
        gaps = own - total / (stop - start)
        far = np.sqrt((gaps * gaps).sum(1))
        at = len(nodes)
        nodes.append([start, stop, -1, -1, float(far.max())])
        sums.append(total)
        if parent >= 0:
            nodes[parent][2 + side] = at
        if stop - start > LEAF and far.max() > 0:  # halves along the line between two far points
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            along = np.argsort((own - a) @ (b - a), kind="stable")
            order[start:stop] = order[start:stop][along]
            middle = (start + stop) // 2
            open_nodes += [(middle, stop, at, 1), (start, middle, at, 0)]
    return order, nodes, np.asarray(sums, np.int64).reshape(len(nodes), -1)


def plant(points: DataFrame, key: str) -> DataFrame:
    """Trees of up to TREE_POINTS points each, local to a partition: their points' keys, points, nodes and node sums."""

    def build(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        node = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("radius", pa.float64())]))
        held: list = []
        n = 0

        def tree(table) -> pa.RecordBatch:
            x = table.column(1).combine_chunks()
            x = np.asarray(x.values if isinstance(x, pa.ListArray) else x.chunk(0).values, np.int64).reshape(table.num_rows, -1)
            if np.abs(x).max(initial=0) > MOST:
                raise ValueError(f"an entry passes {MOST} in fixed point; squared distances would not fit a long")
            order, nodes, sums = build_tree(x)
            keys = table.column(0).take(pa.array(order))
            names = ("start", "stop", "left", "right", "radius")
            return pa.RecordBatch.from_arrays([pa.array([keys.to_pylist()], pa.list_(table.schema.field(0).type)), pa.array([x[order].tobytes()], pa.binary()), pa.array([[dict(zip(names, v)) for v in nodes]], node), pa.array([sums.tobytes()], pa.binary())], names=["keys", "points", "nodes", "sums"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= TREE_POINTS:
                table = pa.Table.from_batches(held)
                yield tree(table.slice(0, TREE_POINTS))
                held, n = table.slice(TREE_POINTS).to_batches(), n - TREE_POINTS
        if n:
            yield tree(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField("keys", T.ArrayType(points.schema[key].dataType)), *T._parse_datatype_string(TREES).fields])
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(key, "x").mapInArrow(build, schema)


def filtered(points, nodes, sums, centroids) -> tuple:
    """(cluster of each point, count and integer sum of each cluster, balls that went whole) for one tree: a level at a time.
    A ball goes whole to the centroid nearest to its centre if every other is farther by more than its diameter; leaves
    are compared point by point in integers, ties going to the smaller number."""
    import numpy as np

    start, stop, left, right = (np.fromiter((v[k] for v in nodes), np.int64) for k in ("start", "stop", "left", "right"))
    radius = np.fromiter((v["radius"] for v in nodes), np.float64)
    cluster, counts, totals = np.zeros(len(points), np.int32), [0] * len(centroids), np.zeros((len(centroids), points.shape[1]), np.int64)
    active, whole = np.zeros(1, np.int64), 0
    while active.size:
        centre = sums[active] / (stop - start)[active, None]
        near = np.sqrt(((centre[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
        first = near.argmin(1)
        second = np.where(np.arange(len(centroids)) == first[:, None], np.inf, near).min(1)
        # a margin for rounding: a ball that is nearly undecided is opened
        sure = second - near[np.arange(len(active)), first] > 2 * radius[active] * (1 + 1e-9) + 1e-6 * (1 + near.max(1))
        for node, c in zip(active[sure].tolist(), first[sure].tolist()):
            cluster[start[node] : stop[node]] = c
            counts[c] += int(stop[node] - start[node])
            totals[c] += sums[node]
        whole += int(sure.sum())
        rest = active[~sure]
        leaves = rest[left[rest] < 0]
        if leaves.size:
            rows = np.concatenate([np.arange(start[v], stop[v]) for v in leaves.tolist()])
            own = points[rows]
            least = np.stack([((own - c) ** 2).sum(1) for c in centroids], 1).argmin(1)
            cluster[rows] = least
            for c in np.unique(least).tolist():
                counts[c] += int((least == c).sum())
                totals[c] += own[least == c].sum(0)
        inner = rest[left[rest] >= 0]
        active = np.concatenate([left[inner], right[inner]])
    return cluster, counts, totals, whole


def _trees(batch, size: int, at: int = 0) -> Iterator:
    import numpy as np

    for i in range(batch.num_rows):
        yield i, *[np.frombuffer(batch.column(at + k)[i].as_py(), np.int64).reshape(-1, size) if k != 1 else batch.column(at + 1)[i].as_py() for k in range(3)]


def step(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every point to its nearest centroid, then each centroid to the floor of its points' mean; one without points
    stays. A task sends a count and a sum for each centroid."""
    size = len(centroids[0])

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, counts, totals = np.asarray(centroids, np.int64), [0] * len(centroids), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            for _, points, nodes, sums in _trees(batch, size):
                _, n, s, _ = filtered(points, nodes, sums, held)
                counts, totals = [a + b for a, b in zip(counts, n)], totals + s
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64()), pa.array(totals.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = trees.select("points", "nodes", "sums").mapInArrow(assign, "cluster int, n long, total array<bigint>")
    # sums of a cluster can pass a long before a point can
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]).where("n > 0").collect()
    moved = [list(c) for c in centroids]
    for r in summed:
        moved[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(size)]
    return moved


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per kept vector: key, cluster, distance (squared), cluster_inertia, inertia (decimal(38,0)), centroid (its entries).

    Kept are vectors with exactly `size` entries, none null or non-finite, as integers floor(scale * entry). The first
    centroids are the k kept vectors with the smallest sha256 of `seed:key`, in that order; a null key comes after all
    others, equal keys go by vector, and with fewer than k vectors there are as many centroids. Each round assigns every vector to
    the nearest (ties: the smaller number) and moves each centroid to the floor of the mean; an empty one stays. A last
    assignment follows. All arithmetic that decides is in integers, so the result does not depend on partitions. An entry
    of more than MOST in fixed point is an error. Repeated rows count each; no kept rows give no rows; other columns are not read.

    Trees are built once, within partitions, and stored; a round reads them and returns a count and a sum for each centroid.
    """
    points = store(fixed_points(rows, vector, key, size, scale), "centroid-points")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    centroids = [list(r["x"]) for r in points.select("x", drawn.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]
    out = T.StructType([T.StructField(key, points.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return _finished(points.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [], key)
    trees = store(plant(points, key), "ball-trees")
    for _ in range(rounds):
        moved = step(trees, centroids)
        if moved == centroids:  # every further round would give the same
            break
        centroids = moved

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = np.asarray(centroids, np.int64)
        for batch in batches:
            for i, own, nodes, sums in _trees(batch, size, 1):
                found = filtered(own, nodes, sums, held)[0]
                keys = batch.column(0)[i].values
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.int32()), pa.array(((own - held[found]) ** 2).sum(1), pa.int64())], names=[key, "cluster", "distance"])

    assigned = store(trees.select("keys", "points", "nodes", "sums").mapInArrow(assign, out), "centroid-assigned")
    by = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    return _finished(assigned, [by.get(c, 0) for c in range(len(centroids))], centroids, key)


def _finished(assigned: DataFrame, inertias: list[int], centroids: list[list[int]], key: str) -> DataFrame:
    """With the inertias and centroids, k values each, as literals."""
    exact = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    of = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))
    listed: list[Column] = [F.array(*map(F.lit, c)) for c in centroids]
    return assigned.select(key, "cluster", "distance", of(map(exact, inertias), "decimal(38,0)").alias("cluster_inertia"), exact(sum(inertias)).alias("inertia"), of(listed, "array<bigint>").alias("centroid"))
