"""Queries of what must hold before a table is trusted: payload contracts, audited versions, events that land once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.payloads import Contract, Field, Together, broken_payloads
from plumbline.plans.offers import table
from plumbline.plans.queries import _event_stream, query
from plumbline.sources import publish
from plumbline.streaming.late import correct_windows, corrected_windows
from plumbline.workspace import shared_dir

CONTRACT = Contract(
    items="$.deals",
    total="$.total",
    fields=(Field("$.id"), Field("$.amount", "double", tests={"small": lambda x: x >= 2000}), Field("$.evidence.line", "int"), Field("$.note", required=False)),
    together=(Together("returned", "$.flag", lambda get: ~((get("$.flag") == "R") & (get("$.quantity", "double") >= 40))),),
    unique=("$.id",),
    unique_overall=("$.serial",),
    apart=(("$.id", "$.rejected", "$.id", "also rejected"),),
)


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus) - 1 AS place FROM lineitem),
g AS (SELECT *, '$.deals[' || place || ']' AS spot FROM l WHERE l_orderkey % 11 <> 0)
SELECT DISTINCT l_orderkey, '$' AS path, 'json' AS rule FROM l WHERE l_orderkey % 11 = 0
UNION ALL SELECT DISTINCT l_orderkey, '$.total', 'total' FROM g WHERE l_orderkey % 5 = 0
UNION ALL SELECT l_orderkey, spot || '.amount', 'type' FROM g WHERE l_tax > 0.07
UNION ALL SELECT l_orderkey, spot || '.amount', 'small' FROM g WHERE l_tax <= 0.07 AND l_extendedprice < 2000
UNION ALL SELECT l_orderkey, spot || '.evidence.line', 'missing' FROM g WHERE l_linestatus = 'O' AND l_discount > 0.08
UNION ALL SELECT l_orderkey, spot || '.flag', 'returned' FROM g WHERE l_returnflag = 'R' AND l_quantity >= 40
UNION ALL SELECT l_orderkey, spot || '.id', 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY place) AS n FROM g) WHERE n > 1
UNION ALL SELECT l_orderkey, spot || '.serial', 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, place) AS n FROM g) WHERE n > 1
UNION ALL SELECT l_orderkey, spot || '.id', 'also rejected' FROM g WHERE EXISTS (SELECT 1 FROM g AS r WHERE r.l_orderkey = g.l_orderkey AND r.l_partkey = g.l_partkey AND r.l_quantity > 47)""")
def q_payload_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as one JSON payload, some of them cut short; every broken rule by its path."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))

    def deal(x):
        shown = F.struct(F.when(~((x["l_linestatus"] == "O") & (x["l_discount"] > 0.08)), x["l_linenumber"]).alias("line"))
        amount = F.when(x["l_tax"] > 0.07, F.lit("n/a")).otherwise(x["l_extendedprice"].cast("string"))
        return F.struct(x["l_partkey"].cast("string").alias("id"), F.concat_ws("-", x["l_partkey"], x["l_suppkey"]).alias("serial"), amount.alias("amount"), x["l_returnflag"].alias("flag"), x["l_quantity"].alias("quantity"), shown.alias("evidence"))

    rejected = F.transform(F.filter("ls", lambda x: x["l_quantity"] > 47), lambda x: F.struct(x["l_partkey"].cast("string").alias("id")))
    total = F.size("ls") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    text = F.to_json(F.struct(total.alias("total"), F.transform("ls", deal).alias("deals"), rejected.alias("rejected")))
    given = orders.select("l_orderkey", text.alias("t")).select("l_orderkey", F.when(F.col("l_orderkey") % 11 == 0, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")).alias("payload"))
    return broken_payloads(given, "l_orderkey", "payload", CONTRACT)


@query("SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_totalprice > 400000) = 0 AS would_go FROM orders GROUP BY o_custkey")
def q_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders are published; a version that would lose customers is refused, and its report says which."""
    root = f"{shared_dir(spark)}/audited-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    feed = lambda rows: {"customers": rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))}
    publish.publish(root, feed(orders), {}, {})
    kept = publish.pinned(spark, root)
    lost = lambda staged: publish.read(spark, root, "customers", pin=kept).join(staged["customers"], "o_custkey", "left_anti")
    publish.publish(root, feed(orders.where("o_totalprice > 400000")), {}, {"no customer is lost": lost})
    gone = publish.read(spark, root, "breaches", "reports").select(F.get_json_object("row", "$.o_custkey").cast("long").alias("o_custkey"), F.lit(True).alias("gone"))
    return publish.read(spark, root, "customers").join(gone, "o_custkey", "left").select("o_custkey", "n_orders", F.coalesce("gone", F.lit(False)).alias("would_go"))


@query("SELECT event_id, min(user_id) AS user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY event_id")
def q_stream_land_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events landed by a stream that is run to its end, and then again from the beginning."""
    root = f"{shared_dir(spark)}/once-{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf_dir)
    for run in range(2):
        write = stream.writeStream.foreachBatch(publish.land_once(root, "event_id", "ts", reread=True)).option("checkpointLocation", f"{root}/state-{run}")
        write.trigger(availableNow=True).start().awaitTermination()
    return publish.landed(spark, root, stream.schema).groupBy("event_id").agg(F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(round(value, 0)) AS total FROM events GROUP BY 1, 2")
def q_stream_late_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the events as they land, one in ten only after all the others: the totals are those of the batch."""
    root = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round("value", 0).alias("value"), "event_id")
    for late in (False, True):
        events.where((F.col("event_id") % 10 == 0) == F.lit(late)).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")
    write = stream.writeStream.foreachBatch(correct_windows(root, "ts", "event_type", "value", "6 hours", 86_400))
    write.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return corrected_windows(spark, root, "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
