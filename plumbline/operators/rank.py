"""Order, caps, rotation and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.workspace import store


def capped(rows: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """At most per_group rows of each group, then at most `total` of all, in the given order."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= per_group)
    return ranked.orderBy(*order).limit(total).drop("_place")


def top(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def rotating_pick(rows: DataFrame, order: list[Column], turn: int, most: int = 7) -> DataFrame:
    """One row of the first `most`: place turn modulo how many there are."""
    first = rows.orderBy(*order).limit(most)
    ranked = first.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    n = first.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(n)).where(F.col("_place") == F.lit(turn) % F.col("_n")).drop("_place", "_n")


def positions(rows: DataFrame, group: list[str], order: list[tuple[str, bool]], tag: str = "positions") -> DataFrame:
    """Add `position` of each row in its group's order, from 0, without a task that holds a group.

    `order` lists columns and whether they ascend, and must be total. Rows are sorted over ranges, each range numbers its
    own rows of a group, and the counts of the ranges before (groups times ranges rows) give each its first number.
    """
    ways = [F.asc(c) if up else F.desc(c) for c, up in order]
    keys = [F.asc(g) for g in group]
    ranged = store(rows.repartitionByRange(*keys, *ways).withColumn("_range", F.spark_partition_id()), tag)
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = store(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), f"{tag}-firsts")
    named = firsts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), "_first")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*ways)) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_range") == F.col("_r")]
    return placed.join(named, on).select(*rows.columns, (F.col("_place") + F.col("_first")).cast("long").alias("position"))


def account_shard(accounts: DataFrame, name: str, priority: str, shard: int, shards: int, hot: int, most: int) -> DataFrame:
    """The `hot` accounts of highest priority in every shard, and each shards-th of the others, `most` in all."""
    ranked = positions(accounts.select(name, priority), [], [(priority, False), (name, True)], "accounts")
    is_hot = F.col("position") < hot
    chosen = ranked.where(is_hot | ((F.col("position") - hot) % shards == shard % shards))
    return chosen.orderBy(F.desc(is_hot), F.desc(priority), name).limit(most).select(name, priority, is_hot.alias("is_hot"))


def chunks(rows: DataFrame, group: str, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """Batches of `size` rows within each group."""
    placed = positions(rows, [group], order, "chunks")
    return placed.withColumn("chunk", F.floor(F.col("position") / size)).withColumn("chunk_place", (F.col("position") % size).cast("int")).drop("position")


def weekly_pick(rows: DataFrame, key: str, order: list[Column], turn: int, excluded: Column, most: int = 100) -> DataFrame:
    """One row of the first `most` that are not excluded, by turn modulo how many there are."""
    return rotating_pick(rows.where(~F.coalesce(excluded, F.lit(False))), order, turn, most)


def featured(rows: DataFrame, eligible: Column, order: list[Column]) -> DataFrame:
    """The first eligible row."""
    return rows.where(F.coalesce(eligible, F.lit(False))).orderBy(*order).limit(1)


def budgeted(rows: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """The distinct keys that a budget of checks covers, best first."""
    return rows.groupBy(key).agg(*[F.max(c).alias(f"_o{i}") for i, c in enumerate(order)]).orderBy(*[F.desc(f"_o{i}") for i in range(len(order))], key).limit(budget).select(key)
