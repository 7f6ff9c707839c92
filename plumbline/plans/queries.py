"""Registered queries: each shows one operator or a whole plan on the given tables, with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import dates, ids, rules, scores, text, urls
from plumbline.operators import contracts, dedup, joins, rank, stats, validity
from plumbline.plans.offers import AS_OF, OFFERS_SQL, as_of, offers, table
from plumbline.sources import landed, publish, sinks
from plumbline.workspace import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL for the functions that several queries use.
def _collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\x09-\x0d ]+', ' ', 'g'))"


def _clean(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    return _collapse(f"""replace(replace(replace({bare}, '&amp;', '&'), '&quot;', '"'), '&#39;', '''')""")


def _noise(x: str) -> str:
    y = _clean(x)
    for word in text.UI_WORDS:
        y = rf"regexp_replace({y}, '\b{word}\b', ' ', 'gi')"
    y = _collapse(rf"regexp_replace(regexp_replace({y}, '\bBestellunge\b', 'Bestellung', 'gi'), '\*{{3,}}', ' ', 'g')")
    return rf"trim(regexp_replace({y}, '^[,:\-–\s]+|[,:\-–\s]+$', '', 'g'))"


def _words(x: str) -> str:
    return rf"trim(regexp_replace(lower({_noise(x)}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _host(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({x}, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"


def _path(x: str) -> str:
    return f"regexp_extract({x}, '^https?://[^/?#]+([^?#]*)', 1)"


# --- scans of landed payloads -------------------------------------------------------------------------------------


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) <> '' AS has_title, list_count(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def q_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n = landed.links(pages, "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id", (landed.page_title(F.col("html")) != "").alias("has_title")).join(n, "page_id", "left").select("page_id", "has_title", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*) AS n FROM l GROUP BY href""")
def q_link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.links(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '<head>.*?</head>', '', 's') AS h FROM pages) SELECT page_id, trim(regexp_extract(h, '<article>', 0)) <> '' AS has_article, length(h) AS body_chars FROM t""")
def q_page_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("html", "(?s)<head>.*?</head>", "")
    return table(spark, sf_dir, "pages").select("page_id", body.contains("<article>").alias("has_article"), F.char_length(body).cast("long").alias("body_chars"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def q_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.char_length("props").cast("long").alias("n"))


@query("SELECT source AS source_key, doc_id % 10 AS position, doc_id AS id, CAST(lang AS VARCHAR) AS title FROM documents")
def q_envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes made of the documents' ids, then read back: half are bare arrays, half are objects."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.floor(F.col("doc_id") / 10).alias("file"))
    record = F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("at"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("source"))))
    bodies = docs.groupBy("file").agg(record.alias("deals"))
    body = F.when(F.col("file") % 2 == 0, F.to_json("deals")).otherwise(F.to_json(F.struct("deals")))
    read = landed.envelopes(bodies.select(F.col("file").cast("string").alias("path"), body.alias("body")))
    return read.select(F.col("record.source").alias("source_key"), (F.col("record.id").cast("long") % 10).alias("position"), F.col("record.id").cast("long").alias("id"), F.col("record.title").alias("title"))


@query("SELECT doc_id, lang AS title, source AS brand, 'http://x/' || doc_id AS url, '' AS expires, lang AS category FROM documents")
def q_thread_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows formatted as messages and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", sinks.message(F.col("lang"), F.col("source"), F.concat(F.lit("http://x/"), F.col("doc_id")), F.lit(""), F.col("lang")).alias("text"))
    return landed.thread_rows(docs).drop("text")


@query("SELECT event_type AS source, CASE WHEN bool_or(value > 400) THEN 'ok' WHEN bool_and(value < 100) THEN 'not-found' ELSE 'error' END AS status, count(*) AS attempts, NOT bool_or(value > 400) AS keep_previous FROM events GROUP BY event_type")
def q_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 400, "ok").when(F.col("value") < 100, "not-found").otherwise("error").alias("status"))
    return landed.source_status(attempts, "source", "status")


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_clean('text')}) AS h, length({_clean('text')}) AS n FROM documents")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.cast("binary")).alias("h"), F.char_length(clean).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({_words('text')}) AS h FROM documents")
def q_word_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_words(F.col("text")).cast("binary")).alias("h"))


@query(f"SELECT doc_id, substr({_collapse('text')}, 1, 90) AS cut FROM documents")
def q_bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 90).alias("cut"))


@query(rf"""WITH t AS (SELECT doc_id, {_collapse('text')} AS x FROM documents), h AS (SELECT doc_id, x, regexp_extract(x, '^(.{{0,105}}) ', 1) AS head FROM t)
SELECT doc_id, CASE WHEN length(x) <= 112 THEN x ELSE CASE WHEN head <> '' THEN head ELSE substr(x, 1, 105) END || '…' END AS cut FROM h""")
def q_truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text")).alias("cut"))


@query("SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) + CAST(contains(lower(text), 'licen') AS INTEGER) AS hits FROM documents")
def q_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_hits(F.col("text"), ["the", "und", "licen"]).alias("hits"))


@query(rf"SELECT page_id, md5({_clean(r'''regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis')''')}) AS h FROM pages")
def q_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text(F.col("html")).cast("binary")).alias("h"))


@query(None)
def q_decode_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.decode_references(landed.page_title(F.col("html"))).alias("title"))


@query(rf"""SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS price, CAST(o_orderkey % 100 AS DOUBLE) AS percent FROM orders""")
def q_price_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("nur "), F.replace(F.round(F.col("o_totalprice"), 2).cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" € statt mehr, minus "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" %"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.price(said).alias("price"), text.percent(said).alias("percent"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 100 BETWEEN 1 AND 23 THEN CAST(c_custkey % 100 AS VARCHAR) || '. Bezirk' ELSE '' END AS district FROM customer")
def q_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("Gasse 5, 1"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("0 Wien"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.district(address).alias("district"))


@query(rf"""WITH b AS (SELECT item_id, unnest(list_distinct([w for w in string_split({_words('text')}, ' ') if length(w) >= 4])) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct([w for w in string_split({_words('text')}, ' ') if length(w) >= 4])) AS w FROM documents),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS n FROM d JOIN b USING (w) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 2 * count(*) >= any_value(n)""")
def q_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share at least half of the item's words, joined on the words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("ws")).select("item_id", F.size("ws").cast("long").alias("n"), F.explode("ws").alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    return docs.join(items, "w").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared")).where(2 * F.col("shared") >= F.col("n"))


@query("SELECT p_partkey, trim(regexp_replace(substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g'), '') AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS brand_key FROM part")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.brand_key(F.col("p_brand")).alias("brand_key"))


@query(r"""WITH t AS (SELECT c_custkey, lower(regexp_replace('@' || c_name, '^@', '')) AS h FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(replace(h, '#', '_'), '^[a-z0-9._]{2,40}$') THEN replace(h, '#', '_') ELSE '' END AS handle FROM t""")
def q_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.handle(F.concat(F.lit("@"), F.replace("c_name", F.lit("#"), F.lit("_")))).alias("handle"))


# --- URLs and ids -----------------------------------------------------------------------------------------------------


@query(rf"""SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, coalesce(list_extract(string_split({_host('url')}, '.'), -2), '') AS name FROM pages""")
def q_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.parameter(url, "page").alias("page"), urls.registered_name(url).alias("name"))


@query(rf"""SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || {_host('url')} || CASE WHEN regexp_replace({_path('url')}, '/+$', '') = '' THEN '/' ELSE lower(regexp_replace({_path('url')}, '/+$', '')) END AS key,
regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS without_fragment FROM pages""")
def q_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.deal_url(F.col("url")).alias("key"), urls.without_fragment(F.col("url")).alias("without_fragment"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, [kv for kv in string_split(regexp_extract(url, '\?([^#]*)', 1), '&') if kv <> '' AND NOT regexp_matches(lower(kv), '^(?:utm_[a-z_]*|igsh[a-z]*|fbclid|gclid|mc_[a-z]+)=')] AS q FROM pages)
SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM t""")
def q_without_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.without_tracking(F.col("url")).alias("url"))


@query("""SELECT doc_id, 'instagram:C' || doc_id || '_x' AS post_key, CASE WHEN doc_id % 3 = 0 THEN 'instagram:p:C' || doc_id || '_x' WHEN doc_id % 3 = 1 THEN 'instagram:reel:C' || doc_id || '_x' ELSE '' END AS queue_key, 'tiktok:video:' || doc_id AS social_key FROM documents""")
def q_post_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("C"), F.col("doc_id"), F.lit("_x"))
    kind = F.element_at(F.array(F.lit("p"), F.lit("reel"), F.lit("reels")), (F.col("doc_id") % 3 + 1).cast("int"))
    plain = F.concat(F.lit("https://www.instagram.com/someone/"), kind, F.lit("/"), code, F.lit("/?igsh=1"))
    login = F.concat(F.lit("https://instagram.com/accounts/login/?next=%2Fp%2F"), code, F.lit("%2F"))
    video = F.concat(F.lit("https://www.tiktok.com/@a/video/"), F.col("doc_id"), F.lit("?x=1"))
    return table(spark, sf_dir, "documents").select("doc_id", urls.post_key(F.when(F.col("doc_id") % 2 == 0, plain).otherwise(login)).alias("post_key"), urls.queue_post_key(plain).alias("queue_key"), urls.social_key(video).alias("social_key"))


@query("SELECT doc_id, 'x-' || substr(sha1(text), 1, 12) AS id FROM documents")
def q_digest_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.digest_id(F.col("text"), "x-").alias("id"))


@query(None)
def q_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.concat_ws("|", "source", "lang", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", ids.xor33(seed).alias("xor33"), ids.polynomial(seed).alias("poly31"), ids.polynomial(seed, 33).alias("poly33"), ids.fnv1a(seed).alias("fnv1a"))


@query("""WITH t AS (SELECT event_id, (1700000000 + event_id * 7) AS s FROM events) SELECT event_id, CAST(s AS BIGINT) AS seconds FROM t""")
def q_video_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = ((F.lit(1700000000) + F.col("event_id") * 7).cast("decimal(38,0)") * F.lit(4294967296) + F.col("event_id")).cast("decimal(38,0)").cast("string")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(urls.video_time(number)).alias("seconds"))


# --- dates ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS ends FROM orders")
def q_parse_dmy(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("gültig bis "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" im Markt"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.dmy(said).alias("parsed"), dates.end_of_day(dates.dmy(said)).cast("timestamp_ntz").alias("ends"))


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'single' WHEN 1 THEN 'end' WHEN 2 THEN 'start' WHEN 3 THEN 'range' ELSE 'recurring' END AS kind,
CASE WHEN k = 0 THEN d END AS valid_on, CASE WHEN k IN (2, 3) THEN d END AS valid_from, CASE WHEN k = 1 THEN d WHEN k = 3 THEN d + 9 END AS valid_until FROM t""")
def q_expiry_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("o_orderkey") % 5
    later = F.date_format(F.date_add("o_orderdate", 9), "d.M.yyyy")
    said = F.when(k == 0, F.concat(F.lit("Am "), day)).when(k == 1, F.concat(F.lit("gültig bis "), day)).when(k == 2, F.concat(F.lit("ab "), day)).when(k == 3, F.concat(day, F.lit(" bis "), later)).otherwise("jeden Mittwoch")
    shape = dates.shape(said, F.to_date(as_of()))
    return table(spark, sf_dir, "orders").select("o_orderkey", shape.alias("s")).select("o_orderkey", "s.kind", "s.valid_on", "s.valid_from", "s.valid_until")


@query("""WITH t AS (SELECT o_orderkey, make_date(CAST(2023 AS BIGINT), month(o_orderdate), least(day(o_orderdate), 28)) AS this, DATE '2023-12-20' AS today FROM orders)
SELECT o_orderkey, CASE WHEN this < today AND date_diff('day', today, CAST(this + INTERVAL 1 YEAR AS DATE)) <= 45 THEN CAST(this + INTERVAL 1 YEAR AS DATE) ELSE this END AS inferred FROM t""")
def q_yearless_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("am "), F.least(F.dayofmonth("o_orderdate"), F.lit(28)).cast("string"), F.lit("."), F.month("o_orderdate").cast("string"), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day_month(said, F.lit("2023-12-20").cast("date")).alias("inferred"))


@query("""SELECT event_id, CAST(date_trunc('week', ts + INTERVAL 1 HOUR) AS DATE)::VARCHAR AS week_key, CAST(ts + INTERVAL 1 HOUR AS DATE) AS local_day, CAST(floor(epoch(ts) / 21600) AS BIGINT) % 4 AS shard FROM events""")
def q_calendar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", dates.week_key(ts).alias("week_key"), dates.local_day(ts).alias("local_day"), dates.six_hour_shard(ts, 4).alias("shard"))


@query(f"""WITH {OFFERS_SQL} SELECT deal_id, CAST(greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(pub_date))) / 86400)) AS BIGINT) AS elapsed, CAST(greatest(0, date_diff('day', CAST(pub_date AS DATE), DATE '2024-01-31')) AS INTEGER) AS calendar FROM offers""")
def q_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("deal_id", dates.elapsed_days(F.col("pub_date"), as_of()).alias("elapsed"), dates.calendar_days(F.col("pub_date"), as_of()).alias("calendar"))


@query(f"""WITH {OFFERS_SQL} SELECT deal_id, coalesce(floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(pub_date)) BETWEEN -300 AND 259200, false) AND coalesce(CAST(expires AS TIMESTAMP) >= TIMESTAMP '{AS_OF}', true) AS is_new FROM offers""")
def q_freshness_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("deal_id", dates.is_fresh(F.col("pub_date"), F.lit(None).cast("timestamp"), F.col("expires").cast("timestamp"), as_of()).alias("is_new"))


# --- classification ---------------------------------------------------------------------------------------------------


#: Small vocabularies for the queries: materials and makes of parts.
_MAKES = (rules.Rule("metal", ("steel", "copper", "brass", "nickel", "tin"), unless=("polished",)), rules.Rule("smooth", ("polished", "burnished")), rules.Rule("small", ("small",), also=("plated",)))
_ALIASES, _WEAK = {"brand#11": "house", "brand#12": "house", "brand#13": "none"}, ("none", "brand#14")
_STRONG = (rules.Rule("promo", ("promo",)),)


def _word_sql(x: str, words: tuple[str, ...]) -> str:
    return rf"regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}])({'|'.join(words)})($|[^\p{{L}}\p{{N}}])')"


def _rule_sql(x: str, rule: rules.Rule) -> str:
    tests = [_word_sql(x, rule.any_of)] + [_word_sql(x, rule.also)] * bool(rule.also) + [f"NOT {_word_sql(x, rule.unless)}"] * bool(rule.unless)
    return f"WHEN {' AND '.join(tests)} THEN '{rule.label}'"


_MADE_SQL = " ".join(_rule_sql("p_type", r) for r in _MAKES)


@query(f"SELECT p_partkey, CASE {_MADE_SQL} ELSE lower(p_brand) END AS type FROM part")
def q_offer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.offer_type(F.col("p_type"), F.col("p_brand"), _MAKES).alias("type"))


@query(f"""WITH u AS (SELECT p_partkey, p_type, CASE lower(p_brand) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIASES.items())} ELSE lower(p_brand) END AS usual FROM part)
SELECT p_partkey, CASE {' '.join(_rule_sql('p_type', r) for r in _STRONG)} WHEN usual IN ({', '.join(f"'{w}'" for w in _WEAK)}) THEN CASE {_MADE_SQL} ELSE usual END ELSE usual END AS category FROM u""")
def q_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.category(F.col("p_brand"), F.col("p_type"), _MAKES, _ALIASES, _WEAK, _STRONG, "other").alias("category"))


_SIGNS = [("license", "licen[sc]e"), ("symbols", r"[#$%&*]{3}"), ("menu", r"\|"), ("shout", "!!")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{label}'" for label, p in _SIGNS) + " ELSE 'plain' END AS label FROM documents")
def q_rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.first_match(F.col("text"), _SIGNS, "plain").alias("label"))


@query("""SELECT d.doc_id, min(r.p || ' ' || r.k || ' ' || r.v) AS reason FROM documents d JOIN (VALUES (1, 'id', '7'), (1, 'id', '11'), (2, 'url', 'src3'), (3, 'text', 'apache license'), (4, 'provider', 'token =')) r(p, k, v)
ON (r.k = 'id' AND CAST(d.doc_id AS VARCHAR) = r.v) OR (r.k = 'url' AND d.source = r.v) OR (r.k IN ('text', 'provider') AND contains(lower(d.text), r.v)) GROUP BY d.doc_id""")
def q_moderation_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([(1, "id", "7"), (1, "id", "11"), (2, "url", "src3"), (3, "text", "apache license"), (4, "provider", "token =")], "priority int, kind string, value string")
    numbered = lists.withColumn("kind", F.col("kind"))
    found = joins.moderated(table(spark, sf_dir, "documents"), numbered, "doc_id", "source", F.col("text"))
    order = lists.groupBy("kind").agg(F.min("priority").alias("p"))
    return found.join(F.broadcast(order), F.split("reason", " ")[0] == F.col("kind")).select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws(" ", F.col("p"), "reason").alias("reason"))


_GATES_SQL = """[x for x in [CASE WHEN expires < DATE '2024-01-31' THEN 'expired' END, CASE WHEN type = 'error' THEN 'bad source' END, CASE WHEN quality_score < 20 THEN 'no concrete offer' END, CASE WHEN pub_date < TIMESTAMP '2024-01-24' THEN 'too old' END] if x IS NOT NULL]"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = [(F.col("expires") < F.lit("2024-01-31").cast("date"), "expired"), (F.col("type") == "error", "bad source"), (F.col("quality_score") < 20, "no concrete offer"), (F.col("pub_date") < F.lit("2024-01-24").cast("timestamp"), "too old")]
    return offers(spark, sf_dir).withColumn("decision", validity.decision(gates, [(F.col("url").isNull(), "no url")])).withColumn("first", validity.first_reason(gates))


@query(f"WITH {OFFERS_SQL} SELECT deal_id, len({_GATES_SQL}) = 0 AS allowed, array_to_string({_GATES_SQL}, '; ') AS reasons, {_GATES_SQL}[1] AS first_reason FROM offers")
def q_validity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("deal_id", "decision.allowed", F.array_join("decision.reasons", "; ").alias("reasons"), F.col("first").alias("first_reason"))


@query(f"WITH {OFFERS_SQL}, r AS (SELECT unnest({_GATES_SQL}) AS value FROM offers) SELECT value, count(*) AS n FROM r GROUP BY value")
def q_block_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_decided(spark, sf_dir), F.col("decision.reasons"))


@query(f"""WITH {OFFERS_SQL}, c AS (SELECT deal_id, 1 AS rank, CAST(expires AS TIMESTAMP) AS moment, 'expires' AS source FROM offers UNION ALL SELECT deal_id, 4, pub_date, 'published' FROM offers WHERE type = 'view' AND pub_date IS NOT NULL UNION ALL SELECT deal_id, 2, pub_date, 'discovered' FROM offers WHERE pub_date IS NOT NULL)
SELECT deal_id, source, moment FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY rank DESC, moment DESC, source DESC) AS n FROM c) WHERE n = 1""")
def q_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = validity.best_candidate((F.lit(1), F.col("expires").cast("timestamp"), "expires"), (F.lit(4), F.when(F.col("type") == "view", F.col("pub_date")), "published"), (F.lit(2), F.col("pub_date"), "discovered"))
    return offers(spark, sf_dir).select("deal_id", best.alias("b")).select("deal_id", "b.source", F.col("b.moment").cast("timestamp_ntz").alias("moment"))


_RANKS = validity.Ranks(fields={"F": 50, "O": 35}, other=20, sources=(("^1", 80), ("HIGH|MEDIUM", 60)), confidence={"A": 6, "N": 3, "R": -8}, doubtful=(("LOW", 9),))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus AS f, o_orderpriority AS s, min(l_returnflag) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT o_orderkey, CAST(CASE WHEN contains(s, 'LOW') THEN 9 ELSE greatest(1, greatest(CASE f WHEN 'F' THEN 50 WHEN 'O' THEN 35 ELSE 20 END, CASE WHEN s LIKE '1%' THEN 80 WHEN contains(s, 'HIGH') OR contains(s, 'MEDIUM') THEN 60 ELSE 0 END) + CASE c WHEN 'A' THEN 6 WHEN 'N' THEN 3 WHEN 'R' THEN -8 ELSE 0 END) END AS INTEGER) AS rank FROM l""")
def q_backed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", validity.backed_rank(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("flag"), _RANKS).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c IN (404, 410, 451) THEN 'invalid' WHEN c IN (401, 403, 408, 409, 423, 425, 429, 500, 502, 503, 504) THEN 'transient' WHEN c BETWEEN 300 AND 399 THEN 'redirect' WHEN c BETWEEN 200 AND 299 THEN 'ok' ELSE 'unknown' END AS status FROM (SELECT l_orderkey, l_linenumber, 200 + l_partkey % 330 AS c FROM lineitem)")
def q_url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", validity.url_status(200 + F.col("l_partkey") % 330).alias("status"))


# --- scores -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {OFFERS_SQL} SELECT deal_id, CAST((CASE WHEN category IN ('en', 'de') THEN 120 ELSE 0 END) + (CASE WHEN quality_score > 60 THEN 90 + deal_id % 90 ELSE 0 END) + (CASE WHEN type = 'click' THEN 25 ELSE 0 END) + (CASE WHEN type = 'view' THEN 8 ELSE 0 END) + (CASE WHEN type = 'signup' THEN 18 ELSE 0 END) + least(25, coalesce(priority, 0)) AS BIGINT) AS score FROM offers""")
def q_daily_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    score = scores.daily(F.col("category").isin("en", "de"), F.col("quality_score") > 60, F.col("deal_id") % 90, kind == "click", kind == "view", kind == "signup", F.col("priority"))
    return offers(spark, sf_dir).select("deal_id", score.cast("long").alias("score"))


@query(f"""WITH {OFFERS_SQL} SELECT deal_id, CAST(CASE type WHEN 'view' THEN 30 WHEN 'click' THEN 24 WHEN 'signup' THEN 18 ELSE 0 END + CASE category WHEN 'en' THEN 22 WHEN 'de' THEN 20 ELSE 0 END + CASE WHEN source <> '' AND source <> 'src0' THEN 12 ELSE 0 END - CASE WHEN source = 'src0' THEN 18 ELSE 0 END + CASE WHEN length(title) >= 14 THEN 8 ELSE 0 END + CASE WHEN length(description) >= 28 THEN 6 ELSE 0 END + CASE WHEN url IS NOT NULL THEN 6 ELSE 0 END + coalesce(greatest(0, 18 - date_diff('day', CAST(pub_date AS DATE), DATE '2024-01-31')), 0) AS BIGINT) AS score FROM offers""")
def q_featured_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == "view", "gratis").when(F.col("type") == "click", "bogo").when(F.col("type") == "signup", "rabatt").otherwise("")
    category = F.when(F.col("category") == "en", "essen").when(F.col("category") == "de", "kaffee").otherwise("")
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.to_date("pub_date"))
    return offers(spark, sf_dir).select("deal_id", scores.featured(kind, category, F.col("source"), F.col("source") == "src0", F.col("title"), F.col("description"), F.col("url").isNotNull(), age).cast("long").alias("score"))


_EVIDENCE_SQL = f"coalesce(priority, 0) * 30 + CASE WHEN category = 'de' THEN 35 ELSE 0 END + CASE WHEN CAST(expires AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' THEN 22 ELSE 4 END + CASE WHEN contains(url, '/en/') THEN 12 ELSE 0 END + least(greatest(quality_score, 0), 100) / 10"


def _evidence():
    return scores.evidence(F.coalesce("priority", F.lit(0)), F.col("category") == "de", F.col("expires").cast("timestamp"), as_of(), F.coalesce(F.col("url").contains("/en/"), F.lit(False)), F.col("quality_score"))


@query(f"WITH {OFFERS_SQL} SELECT deal_id, round({_EVIDENCE_SQL}, 3) AS score FROM offers")
def q_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("deal_id", F.round(_evidence(), 3).alias("score"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS runs, round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 1.0 / count(*) * 100 + least(sum(floor(value)) / count(*) / 4, 20.0) ELSE 0 END, 4) AS performance FROM events GROUP BY user_id")
def q_source_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") == "purchase").alias("hits"), F.sum(F.floor("value")).alias("links"))
    return runs.select("user_id", "runs", F.round(scores.source_performance(F.col("runs"), F.col("hits"), F.col("links")), 4).alias("performance"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS n_chars, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.enrich(docs, table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("long")), "doc_id", {"n_chars": "quality"})


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND s.value > 450)")
def q_anti_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return joins.without_seen(events.select("event_id", "user_id"), events.where("event_type = 'error' and value > 450"), "user_id")


@query("""WITH known AS (SELECT 'lang:' || lang || '|' || source AS key FROM documents WHERE doc_id % 97 = 0 UNION SELECT 'id:' || (doc_id * 3) FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id FROM documents WHERE 'id:' || doc_id NOT IN (SELECT key FROM known) AND 'lang:' || lang || '|' || source NOT IN (SELECT key FROM known)""")
def q_anti_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    pair = F.concat(F.lit("lang:"), F.col("lang"), F.lit("|"), F.col("source"))
    known = docs.where("doc_id % 97 = 0").select(pair.alias("key")).union(docs.where("doc_id % 5 = 0").select(F.concat(F.lit("id:"), F.col("doc_id") * 3).alias("key")))
    return joins.without_any_key(docs, F.array(F.concat(F.lit("id:"), F.col("doc_id")), pair), known, "doc_id").select("doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q_semi_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.registered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), registry, "o_custkey")


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0), e AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS hidden, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS s, CAST(NULL AS VARCHAR) AS p FROM orders WHERE o_orderkey % 4 = 0)
SELECT coalesce(r.k, e.k) AS k, coalesce(e.s, r.s) AS s, coalesce(e.p, r.p) AS p, CASE WHEN r.k IS NULL THEN 'restored' WHEN e.s IS NOT NULL AND e.s IS DISTINCT FROM r.s THEN 'changed:s' ELSE '' END AS change FROM r FULL OUTER JOIN e ON r.k = e.k WHERE NOT coalesce(e.hidden, false)""")
def q_overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    edits = orders.where("k % 4 = 0").select("k", (F.col("k") % 7 == 0).alias("hidden"), F.when(F.col("k") % 2 == 0, "X").alias("s"), F.lit(None).cast("string").alias("p"))
    return joins.overlay(orders.where("k % 3 <> 0"), edits, "k", ["s", "p"], allow_removals=True)


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'R' ELSE s END AS s FROM b WHERE k % 3 <> 0 UNION ALL SELECT o_orderkey, 'new-r' FROM orders WHERE o_orderkey % 10 = 0), l AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'L' ELSE s END AS s FROM b WHERE k % 4 <> 0 UNION ALL SELECT o_orderkey, 'new-l' FROM orders WHERE o_orderkey % 15 = 0)
SELECT coalesce(b.k, r.k, l.k) AS k, CASE WHEN l.k IS NOT NULL AND (b.k IS NULL OR b.s IS DISTINCT FROM l.s) THEN coalesce(l.s, r.s) ELSE r.s END AS s FROM b FULL OUTER JOIN r ON b.k = r.k FULL OUTER JOIN l ON l.k = coalesce(b.k, r.k)
WHERE CASE WHEN b.k IS NOT NULL THEN r.k IS NOT NULL AND l.k IS NOT NULL ELSE true END""")
def q_three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    base = orders.where("k % 5 <> 0")
    remote = base.where("k % 3 <> 0").withColumn("s", F.when(F.col("k") % 11 == 0, "R").otherwise(F.col("s"))).union(orders.where("k % 10 = 0").withColumn("s", F.lit("new-r")))
    local = base.where("k % 4 <> 0").withColumn("s", F.when(F.col("k") % 7 == 0, "L").otherwise(F.col("s"))).union(orders.where("k % 15 = 0").withColumn("s", F.lit("new-l")))
    return joins.three_way_merge(base, remote, local, "k", ["s"])


@query("SELECT e.event_id, e.user_id, (SELECT max_by(p.value, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS latest_value FROM events e WHERE e.event_type = 'view'")
def q_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    latest = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return joins.as_of_join(events.where("event_type = 'view'").select("event_id", "user_id", "ts"), latest, "user_id", "ts", "ts", "value").drop("ts")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def q_missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return joins.missing_references(lines, F.array("l_partkey"), table(spark, sf_dir, "part").where("p_size > 5"), "p_partkey")


# --- dedup and merge --------------------------------------------------------------------------------------------------


@query(f"WITH {OFFERS_SQL} SELECT title, deal_id, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY quality_score DESC, deal_id) AS n FROM offers) WHERE n = 1")
def q_dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.best_values(offers(spark, sf_dir), ["title"], F.struct("quality_score", -F.col("deal_id")), ["deal_id", "quality_score"])


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id")
    return dedup.best_values(docs, ["key"], -F.col("doc_id"), ["doc_id"])


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_extendedprice, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def q_dedup_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    preferred = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", -1).otherwise(-2)
    first = F.struct(preferred, -F.col("l_extendedprice"), -F.col("l_orderkey"), -F.col("l_linenumber"))
    return dedup.best_values(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], first, ["l_orderkey", "l_linenumber"])


@query(f"""WITH {OFFERS_SQL}, s AS (SELECT deal_id, source, url, description, quality_score, pub_date, {_EVIDENCE_SQL} AS score FROM offers)
SELECT url, arg_max(deal_id, (score, -deal_id)) AS primary_id, md5(arg_max(description, (length(description), score, -deal_id))) AS text_hash, max(quality_score) AS quality_score, min(pub_date) AS pub_date, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_merged FROM s GROUP BY url""")
def q_evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).withColumn("score", _evidence())
    merged = dedup.merge_evidence(rows, "url", "score", "deal_id", ["description"], ["quality_score"], ["pub_date"], "source")
    return merged.select("url", "primary_id", F.md5(F.col("description").cast("binary")).alias("text_hash"), "quality_score", F.col("pub_date").cast("timestamp_ntz").alias("pub_date"), "sources", "n_merged")


@query(f"WITH {OFFERS_SQL}, s AS (SELECT *, array_to_string([p for p in [{_host('url')}, source, category, type] if coalesce(p, '') <> ''], '|') AS signature FROM offers) SELECT signature, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(*) > 1 AS is_cluster FROM s GROUP BY signature")
def q_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = dedup.signature(urls.host(F.col("url")), F.col("source"), F.col("category"), F.col("type"))
    return dedup.clusters(offers(spark, sf_dir).withColumn("signature", signature), "signature", "source")


@query(None)
def q_multi_key_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their whole text, or the same letters in any case and spacing."""
    loose = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(loose.cast("binary")).alias("loose"), F.md5(F.col("text").cast("binary")).alias("whole"))
    return dedup.linked_groups(rows, "doc_id", F.array(F.concat(F.lit("l:"), "loose"), F.concat(F.lit("w:"), "whole")))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, 'new' AS tag FROM orders WHERE o_orderkey % 50 = 1) SELECT o_custkey, o_orderkey, 'old' AS tag FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n""")
def q_scope_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return dedup.replace_scopes(orders.withColumn("tag", F.lit("old")), orders.where("o_orderkey % 50 = 1").withColumn("tag", F.lit("new")), "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders")
def q_queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return dedup.upsert(orders, orders.where("o_orderkey % 3 = 0").withColumn("s", F.lit("new")), "o_orderkey")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS repeated FROM events")
def q_repeated_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_offers(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "repeated")


@query("SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def q_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return dedup.exact_difference(left, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")), ["nation"])


# --- statistics -------------------------------------------------------------------------------------------------------


def _rate_sql(n: str) -> str:
    return f"floor({n} * 1.0 / total * 1000 + 0.5) / 1000"


def _clamp_sql(x: str) -> str:
    return f"CAST(greatest(0, least(100, floor({x} + 0.5))) AS DOUBLE)"


_HEALTH_SQL = f"""WITH {OFFERS_SQL}, o AS (SELECT *, md5(description) AS sig FROM offers), spread AS (SELECT sig, count(*) AS n_all FROM o GROUP BY sig),
sh AS (SELECT sig, source, count(*) AS n, count(*) FILTER (category = 'de') AS vienna, count(*) FILTER (type IN ('view', 'click')) AS food, count(*) FILTER (type = 'purchase') AS promo, count(*) FILTER (pub_date >= TIMESTAMP '2024-01-24') AS fresh, count(*) FILTER (url IS NULL OR url = '') AS no_url, sum(quality_score) AS quality FROM o GROUP BY sig, source),
st AS (SELECT source, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_distinct, CAST(sum(CASE WHEN n_all = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, CAST(sum(n - 1) AS BIGINT) AS n_repeated, CAST(sum(vienna) AS BIGINT) AS vienna, CAST(sum(food) AS BIGINT) AS food, CAST(sum(promo) AS BIGINT) AS promo, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(no_url) AS BIGINT) AS no_url, sum(quality) AS quality FROM sh JOIN spread USING (sig) GROUP BY source),
ra AS (SELECT *, {_rate_sql('n_unique')} AS unique_rate, {_rate_sql('vienna')} AS vienna_rate, {_rate_sql('food')} AS food_rate, {_rate_sql('promo')} AS promo_rate, {_rate_sql('fresh')} AS fresh_rate, {_rate_sql('no_url')} AS missing_url_rate, {_rate_sql('n_repeated')} AS duplicate_rate, round(quality / total, 4) AS avg_quality FROM st),
mx AS (SELECT max(total) AS mt, max(n_unique) AS mu, max(fresh) AS mf FROM ra),
sc AS (SELECT ra.*, {_clamp_sql('unique_rate * 22 + vienna_rate * 22 + food_rate * 20 + promo_rate * 16 + fresh_rate * 14 + (1 - missing_url_rate) * 6')} AS health,
  {_clamp_sql('food_rate * 35 + promo_rate * 28 + fresh_rate * 22 + vienna_rate * 15')} AS mission,
  {_clamp_sql('CASE WHEN mt > 0 THEN total * 1.0 / mt ELSE 0 END * 38 + CASE WHEN mu > 0 THEN n_unique * 1.0 / mu ELSE 0 END * 24 + CASE WHEN mf > 0 THEN fresh * 1.0 / mf ELSE 0 END * 23 + (vienna_rate + food_rate + promo_rate) / 3 * 15')} AS coverage,
  {_clamp_sql('vienna_rate * 28 + food_rate * 24 + promo_rate * 22 + fresh_rate * 12 + (1 - duplicate_rate) * 8 + (1 - missing_url_rate) * 6')} AS precision FROM ra, mx)
SELECT * EXCLUDE (quality), {_clamp_sql('health * 0.28 + mission * 0.32 + coverage * 0.2 + precision * 0.2')} AS weight FROM sc"""


@query(_HEALTH_SQL)
def q_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per-source statistics and scores."""
    rows = offers(spark, sf_dir, sig=F.md5(F.col("text").cast("binary")))
    return stats.source_health(rows, "source", "sig", F.col("category") == "de", F.col("type").isin("view", "click"), F.col("type") == "purchase", F.col("pub_date") >= F.lit("2024-01-24").cast("timestamp"), F.col("url"), F.col("quality_score"))


@query(f"WITH {OFFERS_SQL}, c AS (SELECT source, type, count(*) AS n FROM offers GROUP BY source, type) SELECT source, type, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, type) AS INTEGER) AS place FROM c) WHERE place <= 3")
def q_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(offers(spark, sf_dir), "source", "type", 3)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS place FROM f), s AS (SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS samples FROM p WHERE place <= 3 GROUP BY user_id)
SELECT e.user_id, count(*) AS occurrences, count(*) FILTER (event_type = 'purchase') AS promo, count(*) FILTER (value > 250) AS live, any_value(samples) AS samples FROM events e JOIN s USING (user_id) GROUP BY e.user_id""")
def q_registry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.account_rollup(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", 3, promo=F.col("event_type") == "purchase", live=F.col("value") > 250)


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(round(value, 0)) AS v FROM events GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS age FROM r)
SELECT user_id, count(*) AS runs, max(day) AS last_run, sum(v) AS total_v, round(sum(v * pow(0.75, age)), 3) AS recent_v FROM a GROUP BY user_id""")
def q_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.round("value", 0)).alias("v"))
    return stats.decayed(runs, "user_id", "day", ["v"]).withColumn("recent_v", F.round("recent_v", 3))


@query("""WITH h AS (SELECT event_id, event_type, ts FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, event_type, ts FROM events WHERE event_id % 5 = 0)
SELECT event_id, event_type, ts, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM h) WHERE place <= 90""")
def q_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return stats.run_history(events.where("event_id % 7 <> 3 or event_id % 5 <> 0"), events.where("event_id % 5 = 0"), "event_id", "ts", "event_type")


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN value > 250 THEN 'accepted' ELSE 'rejected' END AS outcome, event_type FROM events), x AS (SELECT day, event_type, count(*) AS n FROM r WHERE outcome = 'rejected' GROUP BY 1, 2)
SELECT r.day, count(*) AS raw, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, coalesce((SELECT string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) FROM x WHERE x.day = r.day), '') AS reasons FROM r GROUP BY r.day""")
def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.when(F.col("value") > 250, "accepted").otherwise("rejected").alias("outcome"), "event_type")
    return sinks.run_report(rows, "day", "outcome", "event_type")


@query("SELECT source, array_to_string([x for x in [CASE WHEN count(*) < 50 THEN 'few' END, CASE WHEN avg(n_chars) > 2500 THEN 'long' END, CASE WHEN count(DISTINCT lang) > 3 THEN 'mixed' END] if x IS NOT NULL], ';') AS issues FROM documents GROUP BY source")
def q_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.issues(F.lit(""), [(F.count(F.lit(1)) < 50, "few"), (F.avg("n_chars") > 2500, "long"), (F.count_distinct("lang") > 3, "mixed")])
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(found, ";").alias("issues"))


# --- order and caps ---------------------------------------------------------------------------------------------------


@query(f"WITH {OFFERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality_score DESC, deal_id) AS n FROM offers) SELECT deal_id, source FROM r WHERE n <= 10 ORDER BY quality_score DESC, deal_id LIMIT 30")
def q_per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.capped(offers(spark, sf_dir), "source", [F.desc("quality_score"), F.col("deal_id")], 10, 30).select("deal_id", "source")


@query(f"WITH {OFFERS_SQL} SELECT deal_id, priority, pub_date FROM offers ORDER BY category = 'fr', pub_date DESC NULLS LAST, coalesce(priority, 99), deal_id LIMIT 24")
def q_feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("category") == "fr", F.desc_nulls_last("pub_date"), F.coalesce("priority", F.lit(99)), F.col("deal_id")]
    return rank.top(offers(spark, sf_dir), order, 24).select("deal_id", "priority", F.col("pub_date").cast("timestamp_ntz").alias("pub_date"))


@query(f"WITH {OFFERS_SQL}, f AS (SELECT deal_id, quality_score, row_number() OVER (ORDER BY quality_score DESC, deal_id) - 1 AS n FROM offers) SELECT deal_id, quality_score FROM f WHERE n = 31 % least((SELECT count(*) FROM offers), 7)")
def q_daily_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rotating_pick(offers(spark, sf_dir).select("deal_id", "quality_score"), [F.desc("quality_score"), F.col("deal_id")], turn=31)


@query("""WITH a AS (SELECT user_id, round(sum(value), 2) AS p FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, user_id) - 1 AS n FROM a) SELECT user_id, p, n < 6 AS is_hot FROM r WHERE n < 6 OR (n - 6) % 4 = 1 ORDER BY n < 6 DESC, p DESC, user_id LIMIT 24""")
def q_account_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("p"))
    return rank.account_shard(accounts, "user_id", "p", shard=1, shards=4, hot=6, most=24)


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 25 AS chunk, CAST((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 25 AS INTEGER) AS chunk_place FROM events")
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.chunks(table(spark, sf_dir, "events"), "event_type", [("ts", True), ("event_id", True)], 25).select("event_id", "chunk", "chunk_place")


@query("SELECT url FROM (SELECT url, max(page_id) AS p FROM pages GROUP BY url) ORDER BY p DESC, url LIMIT 43")
def q_check_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.budgeted(table(spark, sf_dir, "pages"), "url", [F.col("page_id")], 43)


# --- state, in batch form ---------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS failures, max(ts) + INTERVAL 6 HOUR AS until FROM events WHERE event_type = 'error' GROUP BY user_id")
def q_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.state import cooling

    return cooling(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts", 6)


@query("""WITH s AS (SELECT user_id, min(ts) AS started FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT s.user_id, s.started, min(p.ts) AS completed FROM s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.started + INTERVAL 15 SECOND AND p.ts <= s.started + INTERVAL 7 DAY GROUP BY s.user_id, s.started""")
def q_claim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    started = events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("started"))
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("_u"), F.col("ts").alias("at"))
    within = (F.col("at") >= F.col("started") + F.expr("INTERVAL 15 SECOND")) & (F.col("at") <= F.col("started") + F.expr("INTERVAL 7 DAY"))
    return started.join(bought, (F.col("user_id") == F.col("_u")) & within, "left").groupBy("user_id", "started").agg(F.min("at").alias("completed"))


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


# --- state, in streams ------------------------------------------------------------------------------------------------


def _drained(stream: DataFrame, tag: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream over landed files emits until it has read them all, written to the shared folder batch by batch. Of a key
    that comes again, as in update mode, the last batch's row counts."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(land).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out").withColumn("batch", F.col("batch").cast("long"))
    if not keys:
        return out.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*").select(*stream.columns)


#: Files of a landed part at most; a file stream lists 10,000 files ahead and should find some parts among them.
MOST_FILES = 1000
#: Rows that are worth a task of their own when they are dealt out.
TASK_ROWS = 100_000


def _event_stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """The events as they land: in so many parts by time (events without a time in the first), one a micro-batch.

    A part is written by the tasks that read it, so it has as many files as tasks found rows of it. Where all rows lie in
    fewer tasks than could work on them, as in a table of few row groups, a part is dealt out first: its files are what the
    tasks of the stream read. A file stream takes files in the order in which they landed, equally many a micro-batch: a
    part of fewer files is filled up with empty ones.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    share = ", ".join(str(i / parts) for i in range(1, parts))
    found = events.select("ts", F.spark_partition_id().alias("t")).selectExpr(f"percentile_approx(unix_timestamp(ts), array({share})) AS b", "count(*) AS n", "size(collect_set(t)) AS tasks").first()
    bounds = found["b"] or []
    part = F.coalesce(sum((F.unix_timestamp("ts") > b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)
    tasks = min(spark.sparkContext.defaultParallelism, found["n"] // TASK_ROWS, MOST_FILES)
    few = found["tasks"] < tasks
    files = tasks if few else min(max(events.rdd.getNumPartitions(), 1), MOST_FILES)
    events.where("false").coalesce(1).write.parquet(f"{path}-empty")
    for i in range(parts):
        rows = events.where(part == i)
        rows = rows.repartition(files, *rows.columns) if few else rows.coalesce(files)
        rows.write.mode("append").parquet(path)
        publish.fill_up(spark, f"{path}-empty", path, (i + 1) * files)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.state import first_seen

    return _drained(first_seen(_event_stream(spark, sf_dir), ["user_id", "event_type"], "ts").select("user_id", "event_type"), "stream-seen")


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.state import windowed_counts

    counted = windowed_counts(_event_stream(spark, sf_dir), "ts", "event_type", "6 hours", "7 days")
    return _drained(counted, "stream-windows", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, round(value, 0) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events)
SELECT user_id, count(*) AS runs, round(sum(value * pow(0.75, age)), 3) AS recent FROM a GROUP BY user_id""")
def q_stream_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.state import decayed_counters

    at = F.unix_millis("ts") * 10**6 + F.col("event_id")
    runs = _event_stream(spark, sf_dir).select("user_id", at.alias("at"), F.round("value", 0).alias("value"))
    return _drained(decayed_counters(runs, "user_id", "at", "value"), "stream-decayed", ["user_id"]).withColumn("recent", F.round("recent", 3))


# --- contracts --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, rule FROM (SELECT doc_id, unnest([x for x in [CASE WHEN NOT n_chars BETWEEN 20 AND 20000 THEN 'length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN NOT length(text) = n_chars THEN 'count' END] if x IS NOT NULL]) AS rule FROM documents)")
def q_contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"length": F.col("n_chars").between(20, 20000), "lang": F.col("lang").isin("en", "de", "fr"), "count": F.char_length("text") == F.col("n_chars")}
    return contracts.broken(table(spark, sf_dir, "documents"), "doc_id", tests)


@query("SELECT url, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1")
def q_contract_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.repeated_keys(table(spark, sf_dir, "pages"), "url")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def q_contract_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.dangling(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer").where("c_nationkey < 12"), "c_custkey")


@query("SELECT s_suppkey, (48 + s_suppkey % 50 / 100.0) BETWEEN 48.10 AND 48.35 AND (16 + s_suppkey % 90 / 100.0) BETWEEN 16.15 AND 16.60 AS inside FROM supplier")
def q_contract_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", validity.in_vienna(48 + F.col("s_suppkey") % 50 / 100, 16 + F.col("s_suppkey") % 90 / 100).alias("inside"))


@query(None)
def q_feed_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.feed_version(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


# --- plain relational operators ---------------------------------------------------------------------------------------


@query("""SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def q_revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT event_id, lag(event_id) OVER w AS previous, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(along).alias("previous"), F.round(F.sum("value").over(along.rowsBetween(-2, 0)), 4).alias("moving"))


@query("SELECT conv_id, count(*) AS n_turns, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def q_conversation_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.char_length("text")).alias("n_chars"))
