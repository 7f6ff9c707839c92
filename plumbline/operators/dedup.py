"""One row a key, merged evidence, and groups that share any of several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import components
from plumbline.operators.joins import join_unique
from plumbline.workspace import store


def best_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def best_values(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """best_by as an aggregation: it combines before the shuffle, so that a hot key costs one row a task."""
    row = F.struct(*columns)
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def signature(url: Column, brand: Column, title: Column, kind: Column) -> Column:
    """The parts that are not empty, joined by a bar."""
    return F.array_join(F.filter(F.array(url, brand, title, kind), lambda p: F.coalesce(p, F.lit("")) != ""), "|")


def clusters(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Per signature: rows, distinct sources, and whether it stands for more than one row."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources")).withColumn("is_cluster", F.col("n_rows") > 1)


def merge_evidence(rows: DataFrame, key: str, score: str, row_id: str, longest: list[str], largest: list[str], earliest: list[str], sources: str) -> DataFrame:
    """Rows of a key become one: texts are the longest (the best row's on a tie), numbers the largest, discoveries the
    earliest, sources their sorted union; `primary_id` is the best row's. All parts combine before the shuffle."""
    rank = lambda c: F.struct(F.char_length(F.coalesce(F.col(c), F.lit(""))), F.col(score), -F.col(row_id))
    return rows.groupBy(key).agg(
        F.max_by(row_id, F.struct(F.col(score), -F.col(row_id))).alias("primary_id"),
        *[F.max_by(c, rank(c)).alias(c) for c in longest],
        *[F.max(c).alias(c) for c in largest],
        *[F.min(c).alias(c) for c in earliest],
        F.array_join(F.sort_array(F.collect_set(sources)), ",").alias("sources"),
        F.count(F.lit(1)).alias("n_merged"),
    )


def linked_groups(rows: DataFrame, row_id: str, keys: Column) -> DataFrame:
    """(row_id, group): rows that share any key, directly or through others. Each key links its rows to its least row,
    so links grow with the keys and not with the square of a key's rows."""
    held = store(rows.select(F.col(row_id).alias("row"), F.explode(keys).alias("key")).where("key is not null and key <> ''"), "group-keys")
    first = store(held.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "group-firsts")
    edges = join_unique(held, first.select("key", "first"), ["key"], first).select(F.col("row").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    found = components(edges).withColumnRenamed("id", "_found")
    return rows.select(row_id).join(found, F.col(row_id) == F.col("_found"), "left").select(row_id, F.coalesce("component", row_id).alias("group"))


def replace_scopes(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """Scopes that `new` brings replace all old rows of theirs."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win over old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def repeated_offers(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Marks every row after the first of its offer."""
    return rows.withColumn("repeated", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def exact_difference(rows: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of the columns that `other` lacks."""
    return rows.select(*columns).distinct().exceptAll(other.select(*columns).distinct())
