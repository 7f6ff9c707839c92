"""Queries of what texts and pages say of their validity, and of merges in the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expiry, hints
from plumbline.operators import greedy
from plumbline.plans.offers import AS_OF, as_of, table
from plumbline.plans.queries import query

#: Month names by number, as the texts of the queries write them.
MONTHS = ("Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
_TODAY = f"DATE '{AS_OF[:10]}'"
#: (text, kind, on, from, until, confidence) in SQL of d (the day), e (nine days on), m (month name) and y (year).
FORMS = (
    ("'Am ' || dmy", "single", "d", "", "", "medium"),
    ("'Angebot gültig bis ' || dmy || ', nur solange verfügbar'", "end", "", "", "d", "high"),
    ("'gültig ab ' || dmy", "start", "", "d", "", "high"),
    ("dmy || ' – ' || dmy2", "range", "", "d", "e", "high"),
    ("'jeden Mittwoch ab ' || dmy", "recurring", "", "", "", "low"),
    ("'Ende ' || m || ' ' || y", "approx-range", "", "first + 19", "last", "medium"),
    ("'bis ' || day || '. ' || m || ' ' || y", "end", "", "", "d", "high"),
    ("'im ' || m || ' ' || y", "month", "", "first", "last", "medium"),
    ("dmy || ' bis 18:00 Uhr'", "single", "d", "", "", "high"),
    ("'Konzert: ' || dmy", "single", "d", "", "", "medium"),
    ("'nur heute, ' || dmy", "single", "today", "", "", "high"),
    ("iso || 'T23:59:59.999Z'", "end", "", "", "d", "medium"),
    ("'3.-9.' || month || '.' || y", "range", "", "first + 2", "first + 8", "high"),
    ("day || '. ' || m || ' - ' || dmy2", "range", "", "d", "e", "high"),
    ("'Siehe Webseite, ' || dmy", "recurring", "", "", "", "low"),
)
_NAMES = ", ".join(f"'{m}'" for m in MONTHS)
_GIVEN_SQL = f"""t AS (SELECT o_orderkey, o_orderdate AS d, CAST(o_orderdate + INTERVAL 9 DAY AS DATE) AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS first,
  last_day(o_orderdate) AS last, {_TODAY} AS today FROM orders)"""


def _by_form(values: list[str]) -> str:
    return "CASE o_orderkey % " + str(len(FORMS)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_DAYS = {i: [f"CAST({f[i]} AS DATE)" if f[i] else "NULL" for f in FORMS] for i in (2, 3, 4)}


@query(f"""WITH {_GIVEN_SQL} SELECT o_orderkey, {_by_form([f"'{f[1]}'" for f in FORMS])} AS kind, {_by_form(_DAYS[2])} AS valid_on, {_by_form(_DAYS[3])} AS valid_from, {_by_form(_DAYS[4])} AS valid_until, {_by_form([f"'{f[5]}'" for f in FORMS])} AS confidence FROM t""")
def q_expiry_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date in one of the forms that offers write: the SQL states the days, the query reads them."""
    day = F.col("o_orderdate")
    other = F.date_add(day, 9)
    written = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(day, "d.M.yyyy").alias("dmy"), F.date_format(other, "dd.MM.yyyy").alias("dmy2"), F.date_format(day, "yyyy-MM-dd").alias("iso"), F.dayofmonth(day).cast("string").alias("day"), F.month(day).cast("string").alias("month"), F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1).alias("m"), F.year(day).cast("string").alias("y"))
    said = written.select("o_orderkey", F.expr(_by_form([f[0] for f in FORMS])).alias("said"))
    return said.select("o_orderkey", expiry.shape(F.col("said"), F.to_date(as_of())).alias("s")).select("o_orderkey", "s.*")


_PAGE_DAY = "CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE)"


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'broad-token' ELSE 'explicit-phrase' END AS evidence, 'text' AS zone, {_PAGE_DAY} AS day,
  'end' AS kind, CASE page_id % 3 WHEN 0 THEN 'gültig bis' WHEN 2 THEN 'letzter tag' END AS phrase, CAST(CASE page_id % 3 WHEN 0 THEN 5 WHEN 2 THEN 2 END AS INTEGER) AS distance FROM pages""")
def q_page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say a day in one of three ways: before the page, that it was updated then; within or after it, that an offer ends then."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "d.M.yyyy")
    page, way = F.coalesce("html", F.lit("")), F.col("page_id") % 3
    said = F.when(way == 0, F.concat(page, F.lit("<p>Alles gültig bis zum "), day, F.lit(".</p>"))).when(way == 1, F.concat(F.lit("<p>Zuletzt aktualisiert am "), day, F.lit("</p>"), page)).otherwise(F.concat(page, F.lit("<footer>"), day, F.lit(": letzter Tag.</footer>")))
    return table(spark, sf_dir, "pages").select("page_id", hints.page_dates(said, F.to_date(as_of())).alias("h")).select("page_id", "h.*")


@query(None)
def q_greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order of their ids, merged as one pass would: by user and hour, user and value, or sign-up day. A later key can pass
    from one record to another. Best is the highest value."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    keys = F.array(F.concat_ws("|", F.lit("h"), "user_id", F.date_trunc("hour", "ts")), F.concat_ws("|", F.lit("v"), "user_id", F.floor("value")), F.when(F.col("event_type") == "signup", F.concat_ws("|", F.lit("d"), "user_id", F.to_date("ts"))))
    return greedy.greedy_merge(events, "event_id", keys, F.col("value"), ["event_id", "user_id", "value"])
