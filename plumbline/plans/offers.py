"""The offers relation that the queries share, built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that the queries take for now.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def offers(spark: SparkSession, sf_dir: str, **early: Column) -> DataFrame:
    """One row per document, with a page's URL, an event as its publication, a label as its quality, an order's priority.
    `early` columns are computed from a document before it is joined, so that a text of which only they are used does not travel."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    docs = table(spark, sf_dir, "documents").withColumns(early).join(F.broadcast(n_pages)).withColumn("page_id", F.col("doc_id") % F.col("n_pages"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("pub_date"), "user_id", "event_type")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"))
    joined = docs.join(pages, "page_id", "left").join(labels, "doc_id", "left").join(events, "doc_id", "left").join(orders, "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("deal_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("description"),
        "source",
        F.col("lang").alias("category"),
        F.col("event_type").alias("type"),
        "url",
        "pub_date",
        F.col("user_id").alias("owner"),
        F.date_add(F.lit("2024-01-31").cast("date"), (F.col("doc_id") % 61 - 30).cast("int")).alias("expires"),
        (F.coalesce("quality", F.lit(0)) * 60 + F.least("n_chars", F.lit(4000)) / 100.0).cast("double").alias("quality_score"),
        "priority",
        *early,
    )


OFFERS_SQL = """offers AS (
  SELECT d.doc_id AS deal_id, substr(d.text, 1, 80) AS title, d.text AS description, d.source, d.lang AS category, e.event_type AS type, p.url,
    e.ts AS pub_date, e.user_id AS owner, DATE '2024-01-31' + CAST(d.doc_id % 61 - 30 AS INTEGER) AS expires,
    CAST(coalesce(l.quality, 0) * 60 + least(d.n_chars, 4000) / 100.0 AS DOUBLE) AS quality_score, CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS priority
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id)"""
