"""Landed payloads (JSON envelopes, feeds, pages) as relations. Bodies arrive as text, one row a file or response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import clean_text, text_of

#: The fields of an offer record that scans read; a payload's other fields are left out.
DEAL = "id string, brand string, title string, description string, type string, category string, source string, originSource string, url string, expires string, validOn string, validFrom string, validUntil string, pubDate string, discoveredAt string, approvedAt string, ownerUsername string, distance string, address string, qualityScore double, votes long, priority long, hot boolean, isNew boolean"
# What stands before the source's key in the name of a pending file.
PENDING = "deals-pending-"


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, body) of every file that matches."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def source_key(path: Column) -> Column:
    return F.regexp_extract(path, rf"{PENDING}([^/]*)\.json$", 1)


def envelopes(files: DataFrame, schema: str = DEAL) -> DataFrame:
    """(path, position, record) of every file, be it a bare array or an object with `deals`; a bad file has no records."""
    body = F.trim(F.col("body"))
    bare = F.from_json(F.when(body.startswith("["), body), f"array<struct<{_typed(schema)}>>")
    inner = F.from_json(F.when(body.startswith("{"), body), f"deals array<struct<{_typed(schema)}>>")["deals"]
    return files.select("path", F.posexplode(F.coalesce(bare, inner)).alias("position", "record"))


def _typed(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (field.split() for field in schema.split(", ")))


def pending(files: DataFrame, excluded: list[str] = (), requested: list[str] | None = None) -> DataFrame:
    """Records of the pending files with their source's key; excluded names are left out, requested ones alone are read."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    chosen = files.where(name.startswith(PENDING) & name.endswith(".json") & ~name.isin(*excluded)) if excluded else files.where(name.startswith(PENDING) & name.endswith(".json"))
    chosen = chosen.where(name.isin(*requested)) if requested else chosen
    return envelopes(chosen).select(source_key(F.col("path")).alias("source_key"), "position", "record.*")


def latest_reports(files: DataFrame) -> DataFrame:
    """The run report of each source; of several files the last name wins."""
    report = F.from_json("body", "runId string, sourceKey string, status string, startedAt string, finishedAt string, durationMs long, counts struct<raw: long, accepted: long, rejected: long>")
    read = files.select("path", report.alias("report")).where("report.sourceKey is not null")
    return read.groupBy("report.sourceKey").agg(F.max_by("report", "path").alias("report")).select("report.*")


def rss_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """(title, link, published, description) of each item of landed feeds."""
    items = feeds.select(*[c for c in feeds.columns if c != body], F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("_item"))
    field = lambda tag: clean_text(F.regexp_replace(F.regexp_extract("_item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return items.select("*", field("title").alias("title"), field("link").alias("link"), field("pubDate").alias("published"), field("description").alias("description")).drop("_item")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href, label) of each link of a page."""
    pattern = F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("label"))
    found = pages.select(key, F.posexplode(pairs).alias("position", "link"))
    return found.select(key, "position", F.col("link.href").alias("href"), clean_text(F.col("link.label")).alias("label"))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by its property or name; empty without one."""
    forward = F.regexp_extract(text_of(html), rf'(?is)<meta\b[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1)
    backward = F.regexp_extract(text_of(html), rf'(?is)<meta\b[^>]*content="([^"]*)"[^>]*(?:property|name)="{name}"', 1)
    return clean_text(F.coalesce(F.nullif(forward, F.lit("")), backward))


def page_title(html: Column) -> Column:
    return clean_text(F.regexp_extract(text_of(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column) -> Column:
    return clean_text(F.regexp_extract(text_of(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def times(html: Column) -> Column:
    """The datetime attributes of time elements."""
    return F.regexp_extract_all(text_of(html), F.lit(r'(?is)<time\b[^>]*datetime="([^"]*)"'), F.lit(1))


def linked_data_dates(html: Column) -> Column:
    """Dates in JSON-LD scripts as (key, value), wherever they are nested."""
    # The keys that carry a date, from the least to the most telling.
    keys = "dateModified|dateCreated|uploadDate|datePublished|startDate|validThrough|endDate"
    scripts = F.regexp_extract_all(text_of(html), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    pattern = F.lit(rf'"({keys})"\s*:\s*"([^"]*)"')
    pairs = lambda s: F.arrays_zip(F.regexp_extract_all(s, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(s, pattern, F.lit(2)).alias("value"))
    return F.flatten(F.transform(scripts, pairs))


def media_items(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Landed media listings: one row per item, with the pictures of carousels beside it."""
    child = "struct<id: string, media_type: string, media_url: string>"
    item = f"struct<id: string, caption: string, media_type: string, media_url: string, permalink: string, timestamp: string, like_count: long, comments_count: long, children: struct<data: array<{child}>>>"
    rows = payloads.select(*[c for c in payloads.columns if c != body], F.explode(F.from_json(body, f"data array<{item}>")["data"]).alias("item"))
    assets = F.coalesce(F.col("item.children.data"), F.array(F.struct(F.col("item.id"), F.col("item.media_type"), F.col("item.media_url"))))
    return rows.select("*", "item.*", assets.alias("assets")).drop("item", "children")


def thread_rows(messages: DataFrame, body: str = "text") -> DataFrame:
    """Rows read back from formatted messages, with a title line and `field: value` lines."""
    line = lambda name: F.trim(F.regexp_extract(body, rf"(?im)^{name}: *(.*)$", 1))
    return messages.select("*", F.trim(F.regexp_extract(body, r"(?m)\A\*?([^*\n]+)\*?", 1)).alias("title"), *[line(n).alias(n) for n in ("brand", "url", "expires", "category")])


def source_status(attempts: DataFrame, source: str, status: str) -> DataFrame:
    """Per source: ok if any attempt was, not-found if all were, else error; `keep_previous` where none was ok."""
    found = attempts.groupBy(source).agg(F.bool_or(F.col(status) == "ok").alias("ok"), F.bool_and(F.col(status) == "not-found").alias("none"), F.count(F.lit(1)).alias("attempts"))
    return found.select(source, F.when(F.col("ok"), "ok").when(F.col("none"), "not-found").otherwise("error").alias("status"), "attempts", (~F.col("ok")).alias("keep_previous"))


def json_rows(files: DataFrame, key: str, body: str, schema: str, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a nested array in landed JSON payloads: (key, position, fields). `fields` maps names to SQL over `item`, the
    array's element, and `root`, the whole payload. A payload that does not parse, or has no array there, gives no rows."""
    read = files.select(key, F.from_json(body, schema).alias("root"))
    rows = read.select(key, "root", F.posexplode(F.col(f"root.{path}")).alias("position", "item"))
    return rows.select(key, "position", *[F.expr(e).alias(n) for n, e in fields.items()])


def cards(pages: DataFrame, key: str, html: str, block: str, fields: dict[str, str]) -> DataFrame:
    """Repeated blocks of a page's HTML, by a pattern, with a field for each pattern's first group inside the block: (key,
    position, fields). A field without a match is empty."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(block), F.lit(0))).alias("position", "_block"))
    return found.select(key, "position", *[F.regexp_extract("_block", p, 1).alias(n) for n, p in fields.items()])


def candidates(hits: DataFrame, key: str, source: str, score: str, at: str) -> DataFrame:
    """What several scans found, one row a key: hits, distinct sources in order, the best score and the first moment."""
    return hits.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.max(score).alias("best"), F.min(at).alias("first_at"))
