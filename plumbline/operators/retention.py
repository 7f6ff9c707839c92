"""What is kept, for how long, and which row stands for several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.dedup import linked_groups
from plumbline.operators.joins import renamed


def several_key_dedup(rows: DataFrame, row_id: str, keys: Sequence[Column], better: Column, columns: Sequence[str]) -> DataFrame:
    """One row of each group that shares any of the keys, directly or through others: the one with the highest `better`.

    Null and empty keys link nothing. `n_merged` counts the group. With two keys this is the two-map, with three the
    three-map deduplication; unlike a pass over maps it does not depend on the order of rows.
    """
    named = [F.concat(F.lit(f"{i}:"), k.cast("string")) for i, k in enumerate(keys)]
    grouped = linked_groups(rows.select(row_id, F.array(*[F.when(k.cast("string") != "", n) for k, n in zip(keys, named)]).alias("_keys")), row_id, F.col("_keys")).withColumnRenamed(row_id, "_row")
    joined = rows.join(grouped, F.col(row_id) == F.col("_row"))
    best = joined.groupBy("group").agg(F.max_by(F.struct(row_id, *columns), better).alias("_best"), F.count(F.lit(1)).alias("n_merged"))
    return best.select("_best.*", "n_merged")


def priority_dedup(rows: DataFrame, keys: Sequence[Column], priority: Column, row_id: str, columns: Sequence[str]) -> DataFrame:
    """One row a key: of the highest source priority, then the least id."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    best = rows.groupBy(*named).agg(F.max_by(F.struct(row_id, *columns), F.struct(priority, -F.col(row_id))).alias("_best"), F.count(F.lit(1)).alias("n_merged"))
    return best.select("_best.*", "n_merged")


def retained(old: DataFrame, new: DataFrame, key: str, at: str, fallback: Sequence[str], as_of: Column, days: int, most: int) -> DataFrame:
    """Old and new evidence in one: the newest row of a key, its empty `fallback` columns filled with the latest value that
    there is; what is older than `days` goes, and the newest `most` stay."""
    every = old.unionByName(new)
    recent = every.where(F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days)))
    others = [c for c in every.columns if c not in (key, at, *fallback)]
    order = F.struct(at, *others, *fallback)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fallback]
    merged = recent.groupBy(key).agg(F.max(at).alias(at), *last, *[F.max_by(c, order).alias(c) for c in others])
    return merged.orderBy(F.desc(at), key).limit(most).select(*every.columns)


def unexpired(queue: DataFrame, queued: Column, expires: Column, social: Column, published: Column, as_of: Column, days: int) -> DataFrame:
    """Adds `dropped`: why a queued row goes (stale after `days`, expired, or social without a date), or null."""
    why = F.when(queued <= as_of - F.make_dt_interval(days=F.lit(days)), "stale").when(expires < as_of, "expired").when(F.coalesce(social, F.lit(False)) & published.isNull(), "undated")
    return queue.withColumn("dropped", why)


def revalidated(rows: DataFrame, state: DataFrame, key: str, blocked: Column, as_of: Column) -> DataFrame:
    """(key, blocked, first_blocked): a blocked row keeps the moment when it was first found blocked; a row that passes again
    loses it. `state` has key and first_blocked of the last time."""
    before = renamed(state.select(key, "first_blocked"), "_s_")
    judged = rows.select(key, F.coalesce(blocked, F.lit(False)).alias("blocked")).join(before, F.col(key) == F.col(f"_s_{key}"), "left")
    return judged.select(key, "blocked", F.when(F.col("blocked"), F.coalesce("_s_first_blocked", as_of)).alias("first_blocked"))


def rejection_history(previous: DataFrame, fresh: DataFrame, accepted: DataFrame, key: str, at: str, score: Column, most_fresh: int, most: int) -> DataFrame:
    """Terminal rejections so far: the best `most_fresh` new ones join the previous ones, the last of each key stands, accepted
    keys leave, and the latest `most` stay."""
    every = previous.unionByName(fresh.orderBy(F.desc(score), key).limit(most_fresh))
    names = [c for c in every.columns if c != key]
    last = every.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(at, *[c for c in names if c != at])).alias("_row")).select(key, "_row.*")
    open_ones = last.join(accepted.select(F.col(key).alias("_a")).distinct(), F.col(key) == F.col("_a"), "left_anti")
    return open_ones.orderBy(F.desc(at), key).limit(most).select(*every.columns)


def pruned(cache: DataFrame, at: str, size: str, key: str, as_of: Column, days: int, most_bytes: int) -> DataFrame:
    """Cache rows no older than `days`, the newest first while their sizes fit in `most_bytes`, with the bytes of all newer ones.

    The running size goes along whole hours first, and by row only within an hour, so that no task ranks the cache.
    """
    from pyspark.sql import Window

    live = cache.where(F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days))).withColumn("_hour", F.date_trunc("hour", at))
    hours = live.groupBy("_hour").agg(F.sum(size).alias("_bytes"))
    newer = hours.withColumn("_newer", F.coalesce(F.sum("_bytes").over(Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_hour").alias("_h"), "_newer")
    inside = Window.partitionBy("_hour").orderBy(F.desc(at), key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(inside), F.lit(0))
    placed = live.withColumn("_before", before).join(newer, F.col("_hour") == F.col("_h"))
    return placed.withColumn("newer_bytes", F.col("_newer") + F.col("_before")).where(F.col("newer_bytes") + F.col(size) <= most_bytes).select(*cache.columns, "newer_bytes")
