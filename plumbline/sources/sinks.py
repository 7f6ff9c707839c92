"""Files that are written back: feeds with a version, run reports, and split reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED_SCHEMA = 1


def feed_version(rows: DataFrame, ordinal: str) -> DataFrame:
    """One row: the version and count of a feed. Rows are digested where they are; only digests meet, in their order.

    Equal rows in equal order have equal versions. The digest is of the row digests, as a feed of any size has to do
    without one task that holds all of it as text: 64-bit parts of 10,000 rows are digested first.
    """
    columns = [c for c in rows.columns if c != ordinal]
    digests = rows.select(F.col(ordinal).alias("_at"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("_d"))
    parts = digests.groupBy(F.floor(F.col("_at") / 10_000).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_at", "_d"))).alias("_rows"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", "_n", F.sha2(F.array_join(F.transform("_rows", lambda r: r["_d"]), ""), 256).alias("_d"))
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("_part", "_d"))).alias("_parts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))
    digest = F.sha2(F.array_join(F.transform("_parts", lambda p: p["_d"]), ""), 256)
    return whole.select(F.concat(F.lit(f"ff{FEED_SCHEMA}-"), F.substring(digest, 1, 20)).alias("version"), F.col("total").cast("long"))


def write_feed(rows: DataFrame, path: str, ordinal: str) -> None:
    """Rows in order as JSON lines, and the version beside them; the committer makes either write all or nothing."""
    rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal).write.mode("overwrite").json(f"{path}/rows")
    feed_version(rows, ordinal).coalesce(1).write.mode("overwrite").json(f"{path}/version")


def write_decisions(rows: DataFrame, path: str, allowed: Column) -> None:
    """Allowed and blocked rows apart."""
    rows.withColumn("allowed", F.coalesce(allowed, F.lit(False))).write.mode("overwrite").partitionBy("allowed").parquet(path)


def run_report(rows: DataFrame, run: str, outcome: str, reason: str, samples: int = 30) -> DataFrame:
    """Per run: counts by outcome, rejections by reason, and the first `samples` reasons' texts."""
    counts = rows.groupBy(run).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col(outcome) == "accepted").alias("accepted"), F.count_if(F.col(outcome) == "rejected").alias("rejected"))
    by_reason = rows.where(F.col(outcome) == "rejected").groupBy(run, reason).agg(F.count(F.lit(1)).alias("n"))
    folded = by_reason.groupBy(run).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(reason).alias("r")))), 1, samples).alias("_r"))
    return counts.join(folded, run, "left").select(run, "raw", "accepted", "rejected", F.coalesce(F.array_join(F.transform("_r", lambda r: F.concat_ws("=", r["r"], (-r["n"]).cast("string"))), ","), F.lit("")).alias("reasons"))


def message(title: Column, brand: Column, url: Column, expires: Column, category: Column) -> Column:
    """A row as a formatted message, which thread_rows reads back."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"\n{name}: "), value)).otherwise("")
    return F.concat(F.lit("*"), title, F.lit("*"), line("brand", brand), line("url", url), line("expires", expires), line("category", category))
