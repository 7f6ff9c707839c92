"""Windows of event time that late rows correct: nothing is left out, and what came late stays visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.publish import claim, names


def _notes(spark: SparkSession, root: str) -> list[dict]:
    """The notes of the batches that are published, in order; one a micro-batch."""
    if not names(spark, f"{root}/batches"):
        return []
    found = spark.read.text(f"{root}/batches", wholetext=True).select("value").collect()
    return sorted((json.loads(r["value"]) for r in found), key=lambda n: n["batch"])


def correct_windows(root: str, time: str, key: str, value: str, width: str, delay_s: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that splits each batch on the stream's own watermark: the latest event time of the batches
    before, less `delay_s` seconds.

    Rows before the watermark are late: they are written to a side table as they are, and their windows are corrected.
    Each batch leaves one row for each window, key and lateness it touches (counts and sums, folded before the shuffle), so
    that a hot key costs no more than its windows, and no state is kept. A batch is published by one atomic note under its
    number: one that dies has changed nothing, and one that comes again is passed over. Rows without a time belong to no
    window and are late. The first batch has no late rows but these.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _notes(spark, root)
        if any(n["batch"] == number for n in done):
            return
        seen = max((n["latest"] for n in done if n["latest"] is not None), default=None)
        late = F.col(time).isNull()
        if seen is not None:
            late = late | (F.unix_micros(time) < seen - delay_s * 1_000_000)
        batch = batch.withColumn("_late", late).persist()
        name = f"{number:012d}-{uuid.uuid4().hex}"
        parts = batch.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("_w"), key, "_late").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        parts.select(F.col("_w.start").alias("start"), key, F.col("_late").alias("late"), "n", "total").write.parquet(f"{root}/parts/{name}")
        batch.where("_late").drop("_late").write.parquet(f"{root}/late/{name}")
        latest = batch.agg(F.max(F.unix_micros(time))).first()[0]
        batch.unpersist()
        claim(spark, f"{root}/batches", f"{number:012d}", json.dumps({"batch": number, "name": name, "latest": max((x for x in (latest, seen) if x is not None), default=None)}))

    return land


def corrected_windows(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(start, key, n, total, n_late): the windows with all corrections so far; n_late of the n rows came late."""
    paths = [f"{root}/parts/{n['name']}" for n in _notes(spark, root)]
    if not paths:
        raise LookupError(f"no batch is published at {root}")
    return spark.read.parquet(*paths).groupBy("start", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The side table: all rows that came late, as they came."""
    return spark.read.parquet(*[f"{root}/late/{n['name']}" for n in _notes(spark, root)])
