"""Statistics of sources, accounts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.workspace import store


def rate(n: Column, total: Column) -> Column:
    """A share in percent to one decimal, as a fraction again: the rounding that reports use."""
    return F.floor(n / total * 1000 + 0.5) / 1000


def source_health(rows: DataFrame, source: str, signature: str, vienna: Column, food: Column, promo: Column, fresh: Column, url: Column, quality: Column) -> DataFrame:
    """Per source: counts, rates and the five scores. Signatures are counted by source, and over all sources by a window on
    these counts; rows without a signature do not count. The few rows per source are stored, so that the maxima that the
    coverage score needs do not read the table again."""
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    shared = rows.where(F.col(signature).isNotNull()).groupBy(signature, source).agg(F.count(F.lit(1)).alias("n"), flag(vienna).alias("vienna"), flag(food).alias("food"), flag(promo).alias("promo"), flag(fresh).alias("fresh"), flag(url.isNull() | (url == "")).alias("no_url"), F.sum(quality).alias("quality"))
    joined = shared.withColumn("n_all", F.sum("n").over(Window.partitionBy(signature)))
    stats = joined.groupBy(source).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.when(F.col("n_all") == 1, 1).otherwise(0)).alias("n_unique"),
        F.sum(F.col("n") - 1).alias("n_repeated"),
        *[F.sum(c).alias(c) for c in ("vienna", "food", "promo", "fresh", "no_url", "quality")],
    )
    of = lambda name, n: rate(F.col(n), F.col("total")).alias(name)
    stats = stats.select("*", of("unique_rate", "n_unique"), of("vienna_rate", "vienna"), of("food_rate", "food"), of("promo_rate", "promo"), of("fresh_rate", "fresh"), of("missing_url_rate", "no_url"), of("duplicate_rate", "n_repeated"), F.round(F.col("quality") / F.col("total"), 4).alias("avg_quality"))
    stats = store(stats, "source-health")
    most = stats.agg(*[F.max(c).alias(f"max_{c}") for c in ("total", "n_unique", "fresh")])
    scored = stats.join(F.broadcast(most)).select("*", scores.health(F.col).alias("health"), scores.mission(F.col).alias("mission"), scores.coverage(F.col).alias("coverage"), scores.precision(F.col).alias("precision"))
    return scored.withColumn("weight", scores.weight(F.col)).drop("max_total", "max_n_unique", "max_fresh", "quality")


def top_values(rows: DataFrame, group: str, value: str, most: int) -> DataFrame:
    """The most frequent values of each group: by count, then value."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("place") <= most)


def histogram(rows: DataFrame, values: Column) -> DataFrame:
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def issues(c: Column, rules: list[tuple[Column, str]]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))


def decayed(runs: DataFrame, key: str, order: str, values: list[str], factor: float = 0.75) -> DataFrame:
    """Per key: runs, sums, and sums in which each run counts `factor` times as much as the next one."""
    aged = runs.withColumn("_age", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1)
    return aged.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.max(order).alias("last_run"), *[F.sum(v).alias(f"total_{v}") for v in values], *[F.sum(F.col(v) * F.pow(F.lit(factor), F.col("_age"))).alias(f"recent_{v}") for v in values])


def run_history(history: DataFrame, report: DataFrame, run_id: str, finished: str, source: str, most: int = 90) -> DataFrame:
    """The report joins the history in place of one with its id; each source keeps its latest `most` runs."""
    every = history.join(report.select(run_id), run_id, "left_anti").unionByName(report)
    return every.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(finished), F.desc(run_id)))).where(F.col("place") <= most)


def account_rollup(rows: DataFrame, account: str, sample: str, order: str, most: int, **counts: Column) -> DataFrame:
    """Per account: its rows, a counter for each condition, its distinct samples (the first `most` in order)."""
    firsts = rows.select(account, sample, order).groupBy(account, sample).agg(F.min(order).alias("_first"))
    ranked = firsts.withColumn("_place", F.row_number().over(Window.partitionBy(account).orderBy("_first", sample))).where(F.col("_place") <= most)
    samples = ranked.groupBy(account).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", sample))), lambda s: s[sample].cast("string")), ",").alias("samples"))
    totals = rows.groupBy(account).agg(F.count(F.lit(1)).alias("occurrences"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in counts.items()])
    return totals.join(samples, account)
