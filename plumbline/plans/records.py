"""Registered queries of the record operators: reviews, retention, summaries, gates, windows of time and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import describe, rules, scores, windows
from plumbline.operators import rank, retention, reviews, summaries, validity
from plumbline.plans.offers import AS_OF, OFFERS_SQL, as_of, offers, table
from plumbline.plans.queries import _drained, _event_stream, query
from plumbline.sources import landed
from plumbline.workspace import store

NOW = f"TIMESTAMP '{AS_OF}'"


def _plain(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- scans ------------------------------------------------------------------------------------------------------------


@query("SELECT n_name, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS INTEGER) AS position, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, round(c_acctbal, 2) AS price, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers landed as one nested payload a nation, and read back."""
    item = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.struct(F.round("c_acctbal", 2).alias("value")).alias("price"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", item.alias("item")))).alias("xs"))
    joined = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    bodies = joined.select("n_name", F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.struct(F.transform("xs", lambda x: x["item"]).alias("items")).alias("data"))).alias("body"))
    schema = "region int, data struct<items:array<struct<id:string,name:string,price:struct<value:double>>>>"
    return landed.json_rows(bodies, "n_name", "body", schema, "data.items", {"id": "item.id", "title": "item.name", "price": "item.price.value", "region": "root.region"})


@query(r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '<p>[^<]*</p>') AS xs FROM pages), u AS (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS position FROM b) SELECT page_id, CAST(position AS INTEGER) AS position, regexp_extract(x, '<p>([^ <]*)', 1) AS first, regexp_extract(x, '([^ >]*)</p>', 1) AS last FROM u""")
def q_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.cards(table(spark, sf_dir, "pages"), "page_id", "html", "<p>[^<]*</p>", {"first": "<p>([^ <]*)", "last": "([^ >]*)</p>"})


@query("SELECT user_id, count(*) AS hits, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, max(value) AS best, min(ts) AS first_at FROM events GROUP BY user_id")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.candidates(_events(spark, sf_dir), "user_id", "event_type", "value", "ts").withColumn("first_at", F.col("first_at").cast("timestamp_ntz"))


# --- reviews and joins ------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 450)")
def q_without_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return reviews.without_rejected(events.where("event_type <> 'error'"), events.where("event_type = 'error'"), "user_id", F.col("value") > 450).select("event_id", "user_id")


@query("""WITH i AS (SELECT user_id AS k, max_by(event_type, (ts, event_id)) AS t, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1), r AS (SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS t, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v, o_orderkey % 7 = 0 AS weak FROM orders)
SELECT o_orderkey, CASE WHEN i.t IS NOT NULL AND (r.t = '' OR weak) THEN i.t ELSE r.t END AS t, CASE WHEN i.v IS NOT NULL AND (r.v IS NULL OR weak) THEN i.v ELSE r.v END AS v,
 array_to_string([x for x in [CASE WHEN i.t IS NOT NULL AND (r.t = '' OR weak) AND i.t IS DISTINCT FROM r.t THEN 't' END, CASE WHEN i.v IS NOT NULL AND (r.v IS NULL OR weak) AND i.v IS DISTINCT FROM r.v THEN 'v' END] if x IS NOT NULL], ',') AS filled FROM r LEFT JOIN i USING (k)""")
def q_supplemented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("t"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    index = _events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("event_type").alias("t"), F.col("value").alias("v"), "ts", "event_id")
    return reviews.supplemented(rows, index, "k", F.struct("ts", "event_id"), ["t", "v"], F.col("o_orderkey") % 7 == 0).drop("k")


@query("""WITH p AS (SELECT s_nationkey AS g, unnest([s_suppkey, s_suppkey * 7, s_suppkey * 1000]) AS id FROM supplier), c AS (SELECT g, count(*) AS n_refs, count(*) FILTER (id NOT IN (SELECT p_partkey FROM part)) AS n_dangling FROM p GROUP BY g), n AS (SELECT s_nationkey AS g, count(*) AS n_places FROM supplier GROUP BY 1)
SELECT n_nationkey AS g, n_regionkey + 2 AS need, coalesce(n_places, 0) AS n_places, coalesce(n_refs, 0) AS n_refs, coalesce(n_dangling, 0) AS n_dangling, coalesce(n_places, 0) >= n_regionkey + 2 AS covered FROM nation LEFT JOIN n ON n.g = n_nationkey LEFT JOIN c ON c.g = n_nationkey""")
def q_map_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.array(F.col("s_suppkey"), F.col("s_suppkey") * 7, F.col("s_suppkey") * 1000).alias("ids"))
    required = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"), (F.col("n_regionkey") + 2).alias("need"))
    return reviews.coverage(places, "ids", "g", table(spark, sf_dir, "part"), "p_partkey", required, "need")


@query(f"WITH {OFFERS_SQL} SELECT deal_id, CASE WHEN type IN ('view', 'click') AND pub_date IS NOT NULL THEN pub_date WHEN deal_id % 3 = 0 THEN CAST(expires AS TIMESTAMP) END AS moment, CASE WHEN type IN ('view', 'click') AND pub_date IS NOT NULL THEN 'stated' WHEN deal_id % 3 = 0 THEN 'decoded' END AS source FROM offers")
def q_publication_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reviews.publication(F.col("pub_date"), F.col("type").isin("view", "click"), F.when(F.col("deal_id") % 3 == 0, F.col("expires").cast("timestamp")))
    return offers(spark, sf_dir).select("deal_id", found.alias("p")).select("deal_id", F.col("p.moment").cast("timestamp_ntz").alias("moment"), "p.source")


@query("""WITH v AS (SELECT l_orderkey AS k, max_by({'d': CASE l_returnflag WHEN 'R' THEN 'remove' WHEN 'A' THEN 'patch' ELSE 'keep' END, 'r': CASE WHEN l_linenumber % 2 = 0 THEN 'dead' ELSE 'taste' END, 'c': l_quantity / 50, 's': CASE WHEN l_linenumber > 2 THEN 'Z' END}, (l_linenumber, l_quantity / 50, CASE l_returnflag WHEN 'R' THEN 'remove' WHEN 'A' THEN 'patch' ELSE 'keep' END)) AS x FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN x IS NULL THEN 'unreviewed' WHEN x.d = 'remove' THEN CASE WHEN x.c >= 0.4 AND x.r = 'dead' AND o_orderkey % 10 <> 0 THEN 'removed' ELSE 'held' END WHEN x.d = 'patch' THEN 'patched' ELSE 'kept' END AS outcome, x FROM orders LEFT JOIN v ON v.k = o_orderkey)
SELECT k, CASE WHEN outcome = 'patched' THEN coalesce(x.s, s) ELSE s END AS s, outcome FROM o""")
def q_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "patch").otherwise("keep")
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("at"), asked.alias("decision"), F.when(F.col("l_linenumber") % 2 == 0, "dead").otherwise("taste").alias("reason"), (F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_linenumber") > 2, "Z").alias("s"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return reviews.reviewed(rows, said, "k", "at", ["s"], F.col("k") % 10 == 0, 0.4, ["dead"])


@query("""WITH r AS (SELECT o_orderkey AS k, 'u' || o_custkey AS url, o_orderpriority AS p FROM orders), i AS (SELECT o_orderkey AS k, 'I' AS p FROM orders WHERE o_orderkey % 9 = 0), u AS (SELECT 'u' || o_custkey AS url, max(o_orderkey) AS m FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1)
SELECT k, url, CASE WHEN i.k IS NOT NULL THEN i.p WHEN u.url IS NOT NULL THEN 'I' ELSE r.p END AS p, CASE WHEN i.k IS NOT NULL THEN 'id' WHEN u.url IS NOT NULL THEN 'url' ELSE '' END AS matched FROM r LEFT JOIN i USING (k) LEFT JOIN u USING (url)""")
def q_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("u"), F.col("o_custkey")).alias("url"), F.col("o_orderpriority").alias("p"))
    return reviews.overridden(rows, rows.where("k % 9 = 0").withColumn("p", F.lit("I")), "k", "url", ["p"])


@query("SELECT event_id, named FROM (SELECT event_id, event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS named, value FROM events) ORDER BY named DESC, value DESC, event_id LIMIT 200")
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return reviews.review_queue(table(spark, sf_dir, "events"), named, "event_id", [F.desc("value"), F.col("event_id")], 200).select("event_id", "named")


@query("""WITH c AS (SELECT user_id, count(*) AS n_rows, max(ts) AS newest FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 480) GROUP BY 1) SELECT user_id, n_rows, newest FROM c ORDER BY n_rows DESC, newest DESC, user_id LIMIT 8""")
def q_owners_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    found = reviews.owners_to_verify(events.where("event_type <> 'error'"), "user_id", "ts", events.where("event_type = 'error' and value > 480"), 8, 3, 5)
    return found.where("is_fixed").select("user_id", "n_rows", _plain("newest"))


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS m, CASE WHEN l_linenumber % 2 = 0 THEN 's' ELSE 'p' END AS f, strftime(l_shipdate, '%Y-%m-%d') AS v FROM lineitem WHERE l_linenumber < 4), w AS (SELECT k, max_by(v, (m, v)) FILTER (f = 's') AS s, max_by(v, (m, v)) FILTER (f = 'p') AS p FROM c GROUP BY k)
SELECT o_orderkey AS k, coalesce(w.s, o_orderstatus) AS s, coalesce(w.p, o_orderpriority) AS p FROM orders LEFT JOIN w ON w.k = o_orderkey""")
def q_commanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands written as messages, read back, and applied to the orders that they name."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber < 4")
    field = F.when(F.col("l_linenumber") % 2 == 0, "s").otherwise("p")
    said = lines.select(F.col("l_linenumber").alias("m"), F.concat(F.lit("Edit "), F.col("l_orderkey"), F.lit(" "), field, F.lit(" = "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("; other=x")).alias("text"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return reviews.commanded(rows, "k", reviews.commands(said, "m", "text", ["s", "p"]), ["s", "p"])


@query("SELECT o_orderkey, CAST(greatest(0, least(999, o_orderkey % 1500 - 100)) AS BIGINT) AS r FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click'))")
def q_existing_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("url"), (F.col("o_orderkey") % 1500 - 100).alias("r"))
    queue = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), "event_type")
    return reviews.existing(mine, queue, "url", F.col("event_type").isin("view", "click"), "r").select("o_orderkey", "r")


@query("SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem UNION SELECT p_partkey, p_partkey % 7 FROM part")
def q_with_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 7).alias("supp"))
    return reviews.with_new_entries(old, new.union(new), ["part", "supp"])


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS posted FROM orders")
def q_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return reviews.acknowledged(table(spark, sf_dir, "orders").select("o_orderkey"), posted, "o_orderkey")


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS f0, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ' + ' ORDER BY f0, event_type) AS reasons, CAST(sum(n) AS BIGINT) AS n_marks, min(f0) AS first_at FROM f GROUP BY user_id")
def q_merged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.merged_reviews(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS report FROM lineitem WHERE l_returnflag IN ('R', 'A')), f AS (SELECT k, n, q, report, row_number() OVER (PARTITION BY k ORDER BY report, n, q) AS p FROM b) SELECT k, n, q, report FROM f WHERE p = 1 ORDER BY q DESC, k LIMIT 100""")
def q_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), "l_returnflag")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    return reviews.removals(of("R"), of("A"), "k", [F.desc("q"), F.col("k")], 100)


@query("SELECT coalesce(CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN lang = 'fr' THEN 'language' WHEN contains(text, '!!') THEN 'shouting' END, 'taken') AS outcome, count(*) AS n FROM documents GROUP BY 1")
def q_ordered_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [(F.col("text").isNull() | (F.col("text") == ""), "empty"), (F.col("n_chars") < 200, "short"), (F.col("lang") == "fr", "language"), (F.col("text").contains("!!"), "shouting")]
    judged = reviews.rejects(table(spark, sf_dir, "documents"), gates)
    return judged.groupBy(F.coalesce("reject", F.lit("taken")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- retention and merges ---------------------------------------------------------------------------------------------


@query(None)
def q_several_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that share an hour or a value, the highest value of each group."""
    events = _events(spark, sf_dir)
    keys = [F.concat_ws("|", "user_id", F.date_trunc("hour", "ts")), F.concat_ws("|", "user_id", F.floor("value")), F.when(F.col("event_type") == "signup", F.concat_ws("|", "user_id", F.to_date("ts")))]
    return retention.several_key_dedup(events, "event_id", keys, F.struct("value", -F.col("event_id")), ["user_id", "value"])


@query("SELECT l_orderkey, l_linenumber, n_merged FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END DESC, l_orderkey * 10 + l_linenumber) AS p, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS n_merged FROM lineitem) WHERE p = 1")
def q_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    kept = retention.priority_dedup(lines, [F.col("l_partkey"), F.col("l_returnflag")], (F.col("l_linestatus") == "F").cast("int"), "id", ["l_orderkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_linenumber", "n_merged")


@query(f"""WITH e AS (SELECT user_id AS k, ts AS t0, event_id AS n, CASE WHEN event_type <> 'view' THEN event_type END AS t FROM events), m AS (SELECT k, max(t0) AS t0, max_by(n, (t0, n)) AS n, max_by(t, (t0, n)) FILTER (t IS NOT NULL) AS t FROM e WHERE t0 >= {NOW} - INTERVAL 14 DAY GROUP BY k) SELECT k, t0 AS "at", n, t FROM m ORDER BY t0 DESC, k LIMIT 100""")
def q_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("n"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("t"))
    return retention.retained(rows.where("n % 2 = 0"), rows.where("n % 2 = 1"), "k", "at", ["t"], as_of(), 14, 100).select("k", _plain("at"), "n", "t")


@query(f"WITH {OFFERS_SQL} SELECT deal_id, CASE WHEN pub_date <= {NOW} - INTERVAL 21 DAY THEN 'stale' WHEN CAST(expires AS TIMESTAMP) < {NOW} THEN 'expired' WHEN lang = 'de' AND pub_date IS NULL THEN 'undated' END AS dropped FROM (SELECT *, category AS lang FROM offers)")
def q_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir)
    return retention.unexpired(rows, F.col("pub_date"), F.col("expires").cast("timestamp"), F.col("category") == "de", F.col("pub_date"), as_of(), 21).select("deal_id", "dropped")


@query(f"SELECT o_orderkey AS k, o_orderstatus = 'F' AS blocked, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE {NOW} END END AS first_blocked FROM orders")
def q_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("first_blocked"))
    found = retention.revalidated(orders.drop("first_blocked"), orders.where("k % 3 = 0"), "k", F.col("o_orderstatus") == "F", as_of())
    return found.select("k", "blocked", _plain("first_blocked"))


@query("""WITH e AS (SELECT user_id AS k, ts AS t0, value AS v, event_id AS n FROM events), f AS (SELECT * FROM e WHERE n % 4 = 0 ORDER BY v DESC, k LIMIT 40), a AS (SELECT * FROM e WHERE n % 4 = 1 UNION ALL SELECT * FROM f), l AS (SELECT k, max(t0) AS t0, max_by(v, (t0, v, n)) AS v FROM a GROUP BY k)
SELECT k, t0 AS "at", v FROM l WHERE k NOT IN (SELECT user_id FROM events WHERE value > 499) ORDER BY t0 DESC, k LIMIT 60""")
def q_rejection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.col("value").alias("v"), F.col("event_id").alias("n"))
    kept = retention.rejection_history(rows.where("n % 4 = 1"), rows.where("n % 4 = 0"), rows.where("v > 499"), "k", "at", F.col("v"), 40, 60)
    return kept.select("k", _plain("at"), "v")


@query(f"""WITH l AS (SELECT event_id, ts, CAST(value AS BIGINT) AS size FROM (SELECT event_id, ts, floor(value) AS value FROM events) WHERE ts >= {NOW} - INTERVAL 10 DAY), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY date_trunc('hour', ts) DESC, ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM l)
SELECT event_id, CAST(newer AS BIGINT) AS newer_bytes FROM r WHERE newer + size <= 200000""")
def q_pruned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _events(spark, sf_dir).select("event_id", "ts", F.floor("value").cast("long").alias("size"))
    return retention.pruned(cache, "ts", "size", "event_id", as_of(), 10, 200_000).select("event_id", F.col("newer_bytes").cast("long").alias("newer_bytes"))


# --- summaries --------------------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT md5(text) AS g, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_distinct, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (s > 1) AS n_shared, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM p")
def q_global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.global_totals(table(spark, sf_dir, "documents").withColumn("g", F.md5(F.col("text").cast("binary"))), "g", "source")


@query("""WITH s AS (SELECT source, count(*) AS n, sum(n_chars) AS c, avg(n_chars) AS a FROM documents GROUP BY source), x AS (SELECT 'rows' AS list, source AS name, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'chars', source, CAST(c AS DOUBLE) FROM s UNION ALL SELECT 'mean', source, CAST(a AS DOUBLE) FROM s)
SELECT list, CAST(p AS INTEGER) AS place, name, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, name) AS p FROM x) WHERE p <= 5""")
def q_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"), F.avg("n_chars").alias("a"))
    return summaries.leaders(per, "source", {"rows": F.col("n"), "chars": F.col("c"), "mean": F.col("a")}, 5).withColumn("value", F.round("value", 4))


@query("""WITH s AS (SELECT source, avg(n_chars) AS a, [x for x in [CASE WHEN count(*) < 50 THEN 'few' END, CASE WHEN avg(n_chars) > 2300 THEN 'long' END] if x IS NOT NULL] AS issues FROM documents GROUP BY source) SELECT source, array_to_string(issues, ';') AS issues, round(a, 6) AS weight FROM s WHERE len(issues) > 0 ORDER BY a, source LIMIT 6""")
def q_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("a"))
    issues = F.array_compact(F.array(F.when(F.col("n") < 50, "few"), F.when(F.col("a") > 2300, "long")))
    return summaries.recommendations(per, "source", issues, F.col("a"), 6).select("source", F.array_join("issues", ";").alias("issues"), F.round("weight", 6).alias("weight"))


@query("SELECT lang, count(*) AS total, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (contains(text, '!!')) AS loud, count(*) FILTER (text IS NULL OR text = '') AS empty FROM documents GROUP BY lang")
def q_verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"short": F.col("n_chars") < 500, "loud": F.col("text").contains("!!"), "empty": F.col("text").isNull() | (F.col("text") == "")}
    return summaries.conditional_counts(table(spark, sf_dir, "documents"), counts, ["lang"])


@query("""WITH c AS (SELECT user_id, count(*) AS raw, count(*) FILTER (event_type = 'purchase' AND value > 400) AS kept, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1), s AS (SELECT *, kept * 1.0 / raw AS share FROM c)
SELECT user_id, round(share, 4) AS kept_share, raw = 0 AS is_empty, errors > 0 AND kept = 0 AS is_failing, share < 0.04 AND NOT (errors > 0 AND kept = 0) AS is_weak, raw > 0 AND NOT (errors > 0 AND kept = 0) AND share >= 0.04 AS ok FROM s""")
def q_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"kept": (F.col("event_type") == "purchase") & (F.col("value") > 400), "errors": F.col("event_type") == "error"}
    return summaries.run_health(summaries.conditional_counts(table(spark, sf_dir, "events"), counts, ["user_id"]), "user_id", "total", "kept", "errors", 0.04)


@query("SELECT lower(c_mktsegment) AS name, CAST(max(c_nationkey) AS INTEGER) AS priority, bool_or(c_acctbal > 9990) AS verified, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END, ',' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END) AS sources FROM customer GROUP BY 1")
def q_account_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", (F.col("c_acctbal") > 9990).alias("v"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("s"))
    return summaries.account_priorities(rows, F.lower("c_mktsegment"), "c_nationkey", "v", "s")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_installs, count(*) FILTER (event_type = 'purchase') >= 15 AS eligible, max(ts) FILTER (event_type = 'purchase') AS last_completed FROM events GROUP BY 1")
def q_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _events(spark, sf_dir).select("user_id", F.when(F.col("event_type") == "purchase", F.col("ts")).alias("done"))
    return summaries.installs(claims, "user_id", "done", 15).select("user_id", "n_installs", "eligible", _plain("last_completed"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS links, max(ts) AS last FROM events GROUP BY 1")
def q_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_type", F.lit(1).cast("long").alias("runs"), F.floor("value").cast("long").alias("links"), F.col("ts").alias("last"), "event_id")
    return summaries.accumulated(rows.where("event_id % 3 = 0").drop("event_id"), rows.where("event_id % 3 <> 0").drop("event_id"), "event_type", ["runs", "links"], "last").withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass|copper') THEN 'red' WHEN regexp_matches(p_type, '(?i)steel') THEN 'grey' END AS bucket, p_retailprice FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice, p_partkey) AS n FROM b WHERE bucket IS NOT NULL)
SELECT bucket, string_agg(p_partkey, ',' ORDER BY n) FILTER (n <= 10) AS ids, count(*) AS n FROM r GROUP BY bucket""")
def q_bucketed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.bucketed_report(table(spark, sf_dir, "part"), "p_partkey", F.col("p_type"), [("red", "brass|copper"), ("grey", "steel")], F.col("p_retailprice"), 10)


# --- windows of time --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS today, 1 + l_partkey % 12 AS bm, 1 + l_suppkey % 28 AS bd, 1 + (l_partkey // 12) % 12 AS em, 1 + l_orderkey % 28 AS ed FROM lineitem), y AS (SELECT *, year(today) AS y, em < bm OR em = bm AND ed < bd AS crossing FROM d),
z AS (SELECT *, CASE WHEN crossing THEN CASE WHEN make_date(y, em, ed) >= today THEN y - 1 WHEN make_date(y, bm, bd) - today <= 45 THEN y ELSE y - 1 END ELSE CASE WHEN make_date(y, em, ed) < today AND make_date(y + 1, bm, bd) - today <= 45 THEN y + 1 ELSE y END END AS b FROM y)
SELECT l_orderkey, l_linenumber, make_date(b, bm, bd) AS begin_day, make_date(CASE WHEN crossing THEN b + 1 ELSE b END, em, ed) AS end_day FROM z""")
def q_range_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: c.cast("int")
    found = windows.range_years(number(1 + F.col("l_partkey") % 12), number(1 + F.col("l_suppkey") % 28), number(1 + F.floor(F.col("l_partkey") / 12) % 12), number(1 + F.col("l_orderkey") % 28), F.to_date("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("s")).select("l_orderkey", "l_linenumber", F.col("s.begin").alias("begin_day"), F.col("s.end").alias("end_day"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, o_orderkey % 5 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN p WHEN 1 THEN p + 1 WHEN 2 THEN p + CAST((7 - isodow(p)) % 7 AS INTEGER) WHEN 3 THEN p + CAST((5 - isodow(p) + 7) % 7 AS INTEGER) END AS end_day, CAST(date_trunc('month', p) AS DATE) + CAST((7 - isodow(date_trunc('month', p))) % 7 AS INTEGER) AS first_sunday FROM d""")
def q_relative_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, ("free today!", "only Tomorrow", "this weekend", "until friday", "soon"))), (F.col("o_orderkey") % 5).cast("int"))
    end = windows.relative_end(said, F.to_date("o_orderdate"), {"today": 0, "tomorrow": 1}, {"friday": "FRI"}, ["weekend"])
    return table(spark, sf_dir, "orders").select("o_orderkey", end.alias("end_day"), windows.first_sunday(F.to_date("o_orderdate")).alias("first_sunday"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS recurring, p_partkey % 4 = 2 AS past FROM part")
def q_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, ("every Monday a free tea. Come!", "every Monday. A free tea", "there was a free tea", "there was one, still free"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", windows.recurring(said, ["every"], ["monday"], ["free"]).alias("recurring"), windows.only_past(said, ["was"], ["still"]).alias("past"))


@query(f"WITH {OFFERS_SQL} SELECT deal_id, CASE WHEN type <> 'error' AND pub_date <= {NOW} + INTERVAL 24 HOUR THEN pub_date WHEN CAST(expires AS TIMESTAMP) <= {NOW} + INTERVAL 24 HOUR THEN CAST(expires AS TIMESTAMP) END AS pub_date FROM offers")
def q_repaired_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = windows.repaired_publication(F.col("pub_date"), F.col("expires").cast("timestamp"), as_of(), F.col("type") != "error")
    return offers(spark, sf_dir).select("deal_id", fixed.cast("timestamp_ntz").alias("pub_date"))


@query(f"""WITH {OFFERS_SQL}, m AS (SELECT *, CASE WHEN regexp_matches(coalesce(description, ''), '(?i)licen[sc]e') THEN 3 WHEN category = 'de' THEN 20 WHEN category = 'fr' THEN 10 ELSE 7 END AS days, epoch({NOW}) - floor(epoch(pub_date)) AS secs FROM offers)
SELECT deal_id, CAST(days AS INTEGER) AS days, CASE WHEN pub_date IS NULL THEN 'undated' WHEN secs < -129600 THEN 'future' WHEN secs > days * 86400 THEN 'too old' END AS gate FROM m""")
def q_age_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = windows.most_age_days(F.coalesce("description", F.lit("")), F.col("category"), [("licen[sc]e", 3)], {"de": 20, "fr": 10}, 7)
    return offers(spark, sf_dir).select("deal_id", days.alias("days"), windows.age_gate(F.col("pub_date"), as_of(), days).alias("gate"))


@query(f"""WITH {OFFERS_SQL}, t AS (SELECT deal_id, DATE '2024-01-31' - CAST(pub_date AS DATE) AS age, CASE WHEN deal_id % 3 = 0 THEN expires END AS stated, CASE WHEN deal_id % 5 = 0 THEN CAST(pub_date AS DATE) END AS rel FROM offers), e AS (SELECT *, coalesce(stated, rel) AS fin FROM t),
w AS (SELECT *, CASE WHEN fin < DATE '2024-01-31' THEN 'over' WHEN fin >= DATE '2024-01-31' THEN 'running' WHEN age BETWEEN 0 AND 14 THEN 'fresh' WHEN age IS NULL THEN 'undated' ELSE 'old' END AS why FROM e)
SELECT deal_id, CAST(age AS INTEGER) AS age_days, fin AS end_day, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN rel IS NOT NULL THEN 'relative' ELSE 'none' END AS end_source, why IN ('running', 'fresh') AS eligible, why FROM w""")
def q_offer_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.timing(F.col("description"), F.col("pub_date"), F.when(F.col("deal_id") % 3 == 0, F.col("expires")), F.when(F.col("deal_id") % 5 == 0, F.to_date("pub_date")), as_of(), 14)
    return offers(spark, sf_dir).select("deal_id", found.alias("t")).select("deal_id", "t.age_days", F.col("t.end").alias("end_day"), "t.end_source", "t.eligible", "t.why")


# --- gates and scores -------------------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)newsletter') THEN 'letters' WHEN regexp_matches(url, '(?i)0') THEN 'zero' END AS label FROM pages")
def q_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", validity.excluded(F.col("html"), F.col("url"), [("letters", "newsletter", ""), ("zero", "", "0")]).alias("label"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 9000 THEN 'declared' WHEN s_nationkey IN (3, 4) THEN 'nation' WHEN s_suppkey / 10.0 BETWEEN 2 AND 4 AND s_nationkey BETWEEN 5 AND 15 THEN 'box' END AS type, CASE WHEN s_acctbal > 9000 THEN s_name WHEN s_nationkey IN (3, 4) THEN CAST(s_nationkey AS VARCHAR) WHEN s_suppkey / 10.0 BETWEEN 2 AND 4 AND s_nationkey BETWEEN 5 AND 15 THEN CAST(s_suppkey AS VARCHAR) END AS value FROM supplier""")
def q_place_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = validity.in_box(F.col("s_suppkey") / 10, F.col("s_nationkey"), 2, 4, 5, 15)
    found = validity.place_evidence([("declared", F.col("s_acctbal") > 9000, F.col("s_name")), ("nation", F.col("s_nationkey").isin(3, 4), F.col("s_nationkey")), ("box", box, F.col("s_suppkey"))])
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("e")).select("s_suppkey", "e.type", "e.value")


@query("""WITH t AS (SELECT p_partkey, regexp_replace(p_type, '(?i)polished|plated', ' ', 'g') AS x, p_retailprice AS p FROM part) SELECT p_partkey, CASE WHEN regexp_matches(x, '(?i)promo') THEN 'promo' WHEN regexp_matches(x, '(?i)^small') THEN 'small' WHEN p <= 1000 THEN 'price' END AS why FROM t""")
def q_concrete_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = validity.concrete_offer(F.col("p_type"), F.col("p_retailprice"), ["polished|plated"], [("promo", "promo"), ("small", "^small")], 1000)
    return table(spark, sf_dir, "part").select("p_partkey", why.alias("why"))


@query(f"WITH {OFFERS_SQL} SELECT deal_id, CASE WHEN deal_id % 4 = 0 AND pub_date IS NULL THEN 'relative without a day' WHEN deal_id % 4 = 0 AND CAST(pub_date AS DATE) < DATE '2024-01-31' THEN 'relative and past' END AS gate FROM offers")
def q_stale_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("deal_id", validity.stale_relative(F.col("deal_id") % 4 == 0, F.col("pub_date"), as_of()).alias("gate"))


@query("""WITH s AS (SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'purchase' AND value > 480) AS hits, count(*) FILTER (event_type = 'click') AS links FROM events GROUP BY 1) SELECT user_id, runs >= 6 AND hits = 0 AND links < 0.25 * runs AS weak, runs % 2 = 0 AND links > 5 AND coalesce(CASE WHEN hits = 0 THEN 'none' END IN ('none'), false) AND runs / 100.0 >= 0.6 AS removable FROM s""")
def q_source_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"hits": (F.col("event_type") == "purchase") & (F.col("value") > 480), "links": F.col("event_type") == "click"}
    per = summaries.conditional_counts(table(spark, sf_dir, "events"), counts, ["user_id"])
    removable = validity.may_remove([F.col("total") % 2 == 0, F.col("links") > 5], F.when(F.col("hits") == 0, "none"), ["none"], F.col("total") / 100, 0.6)
    return per.select("user_id", validity.weak_source(F.col("total"), F.col("hits"), F.col("links"), 6, 0.25).alias("weak"), removable.alias("removable"))


@query("""WITH f AS (SELECT p_partkey, upper(trim(p_brand)) AS brand, trim(p_name) AS title, lower(trim(p_type)) AS kind, CAST(round(p_retailprice, 2) AS DOUBLE) AS price FROM part), d AS (SELECT *, brand || ': ' || title AS label, CASE WHEN length(title) < 12 THEN title || ' (' || kind || ')' ELSE title END AS description FROM f)
SELECT p_partkey, brand, title, kind, price, label, description, CASE WHEN brand = '' OR title = '' THEN 'incomplete' WHEN price < 950 THEN 'too cheap' WHEN contains(kind, 'promo') THEN 'promo' END AS rejected FROM d""")
def q_normalized_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    fields = {"brand": F.upper(F.trim("p_brand")), "title": F.trim("p_name"), "kind": F.lower(F.trim("p_type")), "price": F.round("p_retailprice", 2)}
    derived = {"label": F.concat_ws(": ", "brand", "title"), "description": F.when(F.char_length("title") < 12, F.concat("title", F.lit(" ("), "kind", F.lit(")"))).otherwise(F.col("title"))}
    gates = [((F.col("brand") == "") | (F.col("title") == ""), "incomplete"), (F.col("price") < 950, "too cheap"), (F.col("kind").contains("promo"), "promo")]
    return validity.record(rows, fields, derived, gates).select("p_partkey", *fields, *derived, "rejected")


@query("""SELECT doc_id, CAST(least(100, greatest(0, CASE WHEN n_chars > 500 THEN 40 ELSE 0 END + CASE WHEN lang IN ('en', 'de') THEN 30 ELSE 0 END + CASE WHEN contains(text, '!!') THEN -25 ELSE 0 END + CASE WHEN contains(text, '@') THEN 45 ELSE 0 END)) AS DOUBLE) AS score,
 array_to_string([x for x in [CASE WHEN n_chars > 500 THEN 'long' END, CASE WHEN lang IN ('en', 'de') THEN 'language' END, CASE WHEN contains(text, '!!') THEN 'loud' END, CASE WHEN contains(text, '@') THEN 'address' END] if x IS NOT NULL], ',') AS reasons FROM documents""")
def q_reasoned_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(F.col("n_chars") > 500, 40, "long"), (F.col("lang").isin("en", "de"), 30, "language"), (F.col("text").contains("!!"), -25, "loud"), (F.col("text").contains("@"), 45, "address")]
    return table(spark, sf_dir, "documents").select("doc_id", scores.reasoned(parts).alias("s")).select("doc_id", "s.score", F.array_join("s.reasons", ",").alias("reasons"))


@query("""SELECT user_id, CAST(least(100, greatest(0, least(count(*) FILTER (event_type = 'purchase') * 4, 48) + least(count(*) FILTER (event_type = 'click') * 2, 30) + least(count(*) FILTER (event_type = 'error') * -3, 0))) AS DOUBLE) AS score FROM events GROUP BY user_id""")
def q_capped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("purchase", "click", "error")
    per = summaries.conditional_counts(table(spark, sf_dir, "events"), {k: F.col("event_type") == k for k in kinds}, ["user_id"])
    return per.select("user_id", scores.capped_hits({k: F.col(k) for k in kinds}, {"purchase": 4, "click": 2, "error": -3}, {"purchase": 48, "click": 30, "error": 0}).alias("score"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_brand <> '' AND lower(p_brand) NOT IN ('brand#11') THEN 25 ELSE 0 END + CASE WHEN p_name <> '' AND lower(p_name) NOT IN ('brand#11') THEN 20 ELSE 0 END + CASE WHEN length(p_name) BETWEEN 12 AND 90 THEN 15 ELSE 0 END + CASE WHEN length(p_type) >= 40 THEN 25 ELSE 0 END + CASE WHEN p_type <> '' THEN 15 ELSE 0 END AS DOUBLE) AS score FROM part""")
def q_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scores.quality(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_type"), ["brand#11"]).alias("score"))


_VALID_SQL = """[x for x in [CASE WHEN category = 'fr' THEN 'excluded source' END, CASE WHEN place IS NULL THEN 'no place' END, CASE WHEN offer IS NULL THEN 'no concrete offer' END, CASE WHEN deal_id % 4 = 0 AND pub_date IS NULL THEN 'relative without a day' WHEN deal_id % 4 = 0 AND CAST(pub_date AS DATE) < DATE '2024-01-31' THEN 'relative and past' END, CASE WHEN pub_date IS NULL THEN 'undated' WHEN secs < -129600 THEN 'future' WHEN secs > 20 * 86400 THEN 'too old' END, CASE WHEN expires < DATE '2024-01-31' THEN 'expired' END] if x IS NOT NULL]"""


@query(f"""WITH {OFFERS_SQL}, v AS (SELECT *, CASE WHEN owner % 3 = 0 THEN 'owner' WHEN category IN ('de', 'en') THEN 'language' END AS place, CASE WHEN regexp_matches(coalesce(description, ''), '(?i)licen[sc]e') THEN 'licence' WHEN quality_score / 10 <= 6 THEN 'price' END AS offer, epoch({NOW}) - floor(epoch(pub_date)) AS secs FROM offers)
SELECT deal_id, len({_VALID_SQL}) = 0 AS allowed, array_to_string({_VALID_SQL}, '; ') AS reasons, place, offer FROM v""")
def q_validity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of a record in one: source, place, concrete offer, relative day, age and expiry, each with its reason."""
    place = validity.place_evidence([("owner", F.col("owner") % 3 == 0, F.col("owner")), ("language", F.col("category").isin("de", "en"), F.col("category"))])
    offer = validity.concrete_offer(F.col("description"), F.col("quality_score") / 10, [], [("licence", "licen[sc]e")], 6)
    rows = offers(spark, sf_dir).withColumn("place", place["type"]).withColumn("offer", offer)
    gates = [
        validity.excluded(F.lit(""), F.col("category"), [("excluded source", "", "^fr$")]),
        F.when(F.col("place").isNull(), "no place"),
        F.when(F.col("offer").isNull(), "no concrete offer"),
        validity.stale_relative(F.col("deal_id") % 4 == 0, F.col("pub_date"), as_of()),
        windows.age_gate(F.col("pub_date"), as_of(), F.lit(20)),
        F.when(F.col("expires").cast("timestamp") < as_of(), "expired"),
    ]
    reasons = F.array_compact(F.array(*gates))
    return rows.select("deal_id", (F.size(reasons) == 0).alias("allowed"), F.array_join(reasons, "; ").alias("reasons"), "place", "offer")


# --- order ------------------------------------------------------------------------------------------------------------


@query(f"WITH {OFFERS_SQL} SELECT deal_id FROM offers ORDER BY CASE type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, (url IS NOT NULL) DESC, quality_score DESC, pub_date DESC NULLS LAST, deal_id LIMIT 50")
def q_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("type") == "purchase", 0).when(F.col("type") == "click", 1).otherwise(2)
    return rank.top(offers(spark, sf_dir), [state, F.col("url").isNotNull().desc(), F.desc("quality_score"), F.desc_nulls_last("pub_date"), F.col("deal_id")], 50).select("deal_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS position FROM events")
def q_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.positions(table(spark, sf_dir, "events"), ["event_type"], [("value", False), ("event_id", True)]).select("event_id", "position")


@query(f"WITH {OFFERS_SQL}, f AS (SELECT deal_id, row_number() OVER (ORDER BY quality_score DESC, deal_id) - 1 AS n FROM offers WHERE category IS DISTINCT FROM 'fr' ORDER BY n LIMIT 100) SELECT deal_id FROM f WHERE n = 57 % (SELECT count(*) FROM f)")
def q_weekly_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.weekly_pick(offers(spark, sf_dir), "deal_id", [F.desc("quality_score"), F.col("deal_id")], 57, F.col("category") == "fr").select("deal_id")


@query(f"WITH {OFFERS_SQL} SELECT deal_id, quality_score FROM offers WHERE type = 'purchase' AND CAST(expires AS TIMESTAMP) >= {NOW} ORDER BY quality_score DESC, deal_id LIMIT 1")
def q_featured_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = (F.col("type") == "purchase") & (F.col("expires").cast("timestamp") >= as_of())
    return rank.featured(offers(spark, sf_dir), eligible, [F.desc("quality_score"), F.col("deal_id")]).select("deal_id", "quality_score")


# --- claims in a stream -----------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS started FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT s.user_id, min(c.at) IS NOT NULL AS completed FROM s LEFT JOIN (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type = 'purchase') c ON c.user_id = s.user_id AND c.at - s.started BETWEEN 15 AND 604800 GROUP BY s.user_id""")
def q_stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first signup starts a claim, a purchase in time completes it: landed in three files, one a micro-batch. Later
    signups are left out before the stream, as a start beyond the claim's time begins it again."""
    from plumbline.streaming.state import claims

    firsts = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first")).withColumnRenamed("user_id", "_u")
    firsts = store(firsts, "first-signups")  # each micro-batch reads it
    kinds = F.when(F.col("event_type") == "signup", "start").otherwise("complete")
    stream = _event_stream(spark, sf_dir).where("event_type in ('signup', 'purchase')").join(firsts, F.col("user_id") == F.col("_u")).where((F.col("event_type") == "purchase") | (F.col("ts") == F.col("first")))
    moves = stream.select(F.col("user_id"), kinds.alias("kind"), F.unix_timestamp("ts").alias("at"), F.lit("a").alias("inviter"), F.lit("b").alias("visitor"), "ts")
    return _drained(claims(moves, "user_id", "kind", "at", "inviter", "visitor", "ts"), "stream-claims", ["user_id"]).select("user_id", (F.col("status") == "completed").alias("completed"))


# --- short texts and links --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || ' is ' || p_type || '. It costs ' || p_size || ' today!' AS summary FROM part WHERE length(p_name || ' is ' || p_type || '. It costs ' || p_size || ' today!') <= 120")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" "), F.col("p_name"), F.lit("  is "), F.col("p_type"), F.lit(".\n It costs "), F.col("p_size"), F.lit(" today!  And more follows."))
    both = F.concat("p_name", F.lit(" is "), "p_type", F.lit(". It costs "), F.col("p_size"), F.lit(" today!"))
    return table(spark, sf_dir, "part").where(F.char_length(both) <= 120).select("p_partkey", describe.summary(said, 120).alias("summary"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name || ' | ' || p_type END AS description, lower(p_type) AS bare FROM part")
def q_without_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("p_brand", F.lit(" | new price | "), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")), F.lit(" |  "), "p_type")
    bare = describe.without_brand(F.concat("p_brand", F.lit(": "), "p_type", F.lit(" - "), F.upper("p_brand")), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", describe.without_echoes(said, [F.col("p_brand")], ["new", "price"]).alias("description"), bare.alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name || ' • ' || p_brand ELSE p_type END AS description, p_size < 25 AS generic FROM part")
def q_fallback_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") < 10, "small").otherwise("other")
    name = F.when(F.col("p_size") < 25, "n/a").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", describe.fallback_description(kind, {"small": [F.col("p_name"), F.lit(None), F.col("p_brand")]}, [F.lit(""), F.col("p_type")]).alias("description"), describe.is_generic(name, ["n/a"]).alias("generic"))


@query("SELECT s_suppkey, s_name AS inside, 'nation ' || s_nationkey AS after, 'friday ' || s_suppkey AS phrase, 'half price ' || s_suppkey AS title FROM supplier")
def q_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = describe.bracketed(F.concat(F.lit("Tea ( "), "s_name", F.lit(") at home")), ["at"])
    after = describe.bracketed(F.concat(F.lit("Tea at nation "), F.col("s_nationkey"), F.lit(", today")), ["at"])
    phrase = describe.phrase_after(F.concat(F.lit("Tea. Valid until:  friday "), F.col("s_suppkey"), F.lit("; or so")), ["valid until", "ends"])
    title = describe.title_of(F.concat(F.lit("hello\nThe Shop: half price "), F.col("s_suppkey"), F.lit("\nbye")), F.lit("the shop"), "price")
    return table(spark, sf_dir, "supplier").select("s_suppkey", inside.alias("inside"), after.alias("after"), phrase.alias("phrase"), title.alias("title"))


@query("""SELECT s_suppkey, ['https://x.example/a/b/' || s_suppkey, 'https://x.example/r', 'https://y.example/z', 'https://x.example/a/up', 'https://x.example/a/b/c?q=1', '', 'http://z.example/' || s_suppkey] AS links FROM supplier""")
def q_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lit("https://x.example/a/b/c?old=1#part")
    links = [F.col("s_suppkey").cast("string"), F.lit("/r"), F.lit("//y.example/z"), F.lit("../up"), F.lit("?q=1"), F.lit("mailto:a@b.c"), F.concat(F.lit("http://z.example/"), F.col("s_suppkey"))]
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*[describe.resolved(x, base) for x in links]).alias("links"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cust_' || c_custkey ELSE 'p' || c_custkey END AS owner, 'shop.example/x?id=' || c_custkey || '&v=2' AS identity, list_sort(['http://shop.example/x/', 'https://shop.example/x/', 'https://shop.example/x', 'https://shop.example/x/?id=' || c_custkey]) AS variants FROM customer""")
def q_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("@Cust_"), F.col("c_custkey"))).otherwise("explore")
    profile = F.concat(F.lit("https://site.example/p"), F.col("c_custkey"), F.lit("/?x=1"))
    found = describe.owner([F.lit("not a name"), named], profile, ["explore"])
    shown = F.concat(F.lit("https://www.Shop.example/x/?utm=1&v=2&id="), F.col("c_custkey"), F.lit("#top"))
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("owner"), describe.identity_url(shown, ["id", "v"]).alias("identity"), describe.url_variants(F.concat(F.lit("https://shop.example/x/?id="), F.col("c_custkey"))).alias("variants"))


@query("SELECT c_custkey, ['one', 'c' || c_custkey, 'two'] AS names, c_name AS brand, c_mktsegment AS kind, '' AS place FROM customer")
def q_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" @One, #c"), F.col("c_custkey"), F.lit(";one\n TWO "))
    fields = describe.signature_fields(F.concat_ws("|", "c_name", "c_mktsegment"), ["brand", "kind", "place"])
    return table(spark, sf_dir, "customer").select("c_custkey", describe.listed_names(said).alias("names"), *fields)
