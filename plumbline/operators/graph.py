"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import HOT
from plumbline.workspace import store

#: Links that one task joins at once; more go by rounds.
LOCAL = 10_000


def _joined_at_once(edges: DataFrame) -> DataFrame:
    """(id, component) of at most LOCAL links, as components() gives them."""

    def join(parts):
        import pandas as pd

        near: dict = {}

        def root(x):
            while (up := near.setdefault(x, x)) != x:
                near[x] = x = near[up]
            return x

        for pdf in parts:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                a, b = root(a), root(b)
                near[max(a, b)] = min(a, b)
        found = [(x, r) for x in list(near) if (r := root(x)) != x]
        if found:
            yield pd.DataFrame(found, columns=["id", "component"])

    kind = dict(edges.dtypes)["a"]
    return edges.coalesce(1).mapInPandas(join, f"id {kind}, component {kind}")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) for every id in edges (a, b) but the least of its group; component is the least id reachable.

    Each id hands its neighbours to the least one near it until nothing changes; LOCAL links or fewer are joined by one task at
    once. Every round is written to the shared
    folder; nothing but one count and one hash reaches the driver. Links of an id to itself add nothing. An id near more
    than one in HOT of all ends meets its least neighbour by broadcast (there are less than HOT such ids), so that no task
    holds a hub's neighbours.
    """

    def ends(df: DataFrame) -> DataFrame:
        return df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(df: DataFrame, large: bool, n_ends: int) -> DataFrame:
        near = ends(df)
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        is_hub = F.col("n") * HOT > n_ends
        hubs, others = F.broadcast(least.where(is_hub).select("a", "m")), least.where(~is_hub).select("a", "m")
        meet = lambda part: part.join(hubs, "a").unionByName(part.join(F.broadcast(least.where(is_hub).select("a")), "a", "left_anti").join(others, "a"))
        if large:
            return meet(near.where("b > a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = meet(near.where("b < a")).select("b", "m")
        own = least.select(F.col("a").alias("b"), "m")
        return down.union(own).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = mark(current)
    if seen[0] <= LOCAL:
        return store(_joined_at_once(current), "components")
    for _ in range(most_rounds):
        current = store(star(current, True, 2 * seen[0]), "components")
        current = store(star(current, False, 2 * current.count()), "components")
        now = mark(current)
        if now == seen:
            return current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
