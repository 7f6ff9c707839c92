"""Data contracts: each rule returns the rows that break it, so that an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that does not hold; a null outcome breaks the rule."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.col(key), F.explode(failed).alias("rule"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Keys that refer to nothing."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(F.col(known_key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")


def too_many(rows: DataFrame, key: str, most: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
