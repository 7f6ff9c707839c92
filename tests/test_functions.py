"""Table cases of the scalar functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import validity
from plumbline.functions import dates, rules, text, urls
from plumbline.operators import dedup, joins
from plumbline.sources import landed



def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def said(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("raw", ["4.9.2026", "04.09.2026", "4/9/2026", "gültig bis 4.9.26"])
def test_day_comes_before_month(spark, raw):
    assert value(spark, dates.dmy(said(raw))) == datetime.date(2026, 9, 4)


@pytest.mark.parametrize(
    ("raw", "kind", "on", "begin", "end"),
    [
        ("Am 29.06.", "single", "2026-06-29", None, None),
        ("gültig bis 30.9.2026", "end", None, None, "2026-09-30"),
        ("ab 1.8.2026", "start", None, "2026-08-01", None),
        ("1.8.2026 bis 15.8.2026", "range", None, "2026-08-01", "2026-08-15"),
        ("jeden Mittwoch", "recurring", None, None, None),
        ("im August", "month", None, "2026-08-01", "2026-08-31"),
        ("solange der Vorrat reicht", "unknown", None, None, None),
        ("", "unknown", None, None, None),
        (None, "unknown", None, None, None),
        ("31.2.2026", "unknown", None, None, None),
    ],
)
def test_shape(spark, raw, kind, on, begin, end):
    got = value(spark, dates.shape(said(raw), F.lit("2026-06-27").cast("date")))
    day = lambda x: x and datetime.date.fromisoformat(x)
    assert (got["kind"], got["valid_on"], got["valid_from"], got["valid_until"]) == (kind, day(on), day(begin), day(end))


def test_vague(spark):
    for raw, vague in (("2026-05-08T23:59:59.999Z", False), ("Kurzfristig / siehe Seite", True), ("Ganztägig", True), ("Gutschein-abhängig", True), ("", True), ("bis 3.4.2026", False)):
        assert value(spark, dates.is_vague(said(raw))) is vague, raw


def test_year_inference(spark):
    late = F.lit("2026-12-20").cast("date")
    assert value(spark, dates.single_year(F.lit(1), F.lit(5), late)) == 2027
    assert value(spark, dates.single_year(F.lit(6), F.lit(5), late)) == 2026
    assert value(spark, dates.month_year(F.lit(2), late)) == 2027
    assert value(spark, dates.plausible(F.lit("2006-06-05").cast("date"), late)) == datetime.date(2026, 6, 5)


def test_freshness(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    now, none = at("2026-06-30 12:00:00"), F.lit(None).cast("timestamp")
    cases = [("2026-06-20 12:00:00", "2026-06-30 11:00:00", None, False), (None, "2026-06-30 11:00:00", None, True), ("2026-06-30 12:10:00", None, None, False), ("2026-06-30 11:00:00", None, "2026-06-30 11:30:00", False), ("2026-06-30 11:00:00", None, None, True), (None, None, None, False)]
    for published, approved, expires, fresh in cases:
        assert value(spark, dates.is_fresh(at(published) if published else none, at(approved) if approved else none, at(expires) if expires else none, now)) is fresh


def test_epochs_and_ages(spark):
    for raw, want in (("1700000000", 1700000000), ("1700000000000", 1700000000), ("2023-11-14T22:13:20Z", 1700000000), ("rubbish", None), ("", None), (None, None)):
        assert value(spark, F.unix_seconds(dates.iso_or_epoch(said(raw)))) == want
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert value(spark, F.unix_seconds(now) - F.unix_seconds(dates.relative_age(said("vor 3 Tagen"), now))) == 3 * 86400
    assert value(spark, F.unix_seconds(now) - F.unix_seconds(dates.relative_age(said("5h ago"), now))) == 5 * 3600


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.instagram.com/p/AbC_1/?x=1", "instagram:AbC_1"),
        ("https://instagram.com/reel/AbC_1", "instagram:AbC_1"),
        ("https://m.instagram.com/someone/tv/abc_1/", "instagram:abc_1"),
        ("https://www.instagram.com/accounts/login/?next=%2Fp%2FAbC_1%2F", "instagram:AbC_1"),
        ("https://www.facebook.com/ads/library/?utm=1&id=77", "meta-ad:77"),
        ("HTTPS://www.Example.com/Path/?q=1#f", "https://example.com/path"),
        ("https://example.com", "https://example.com/"),
        ("ftp://example.com", ""),
        (None, ""),
    ],
)
def test_deal_url(spark, url, key):
    assert value(spark, urls.deal_url(said(url))) == key


def test_ids_that_hold_a_time(spark):
    digits = urls.SHORTCODE_DIGITS
    wanted = 1700000000000
    number, code = (wanted - urls.SHORTCODE_EPOCH_MS) * urls.SHORTCODE_SHIFT + 5, ""
    while number:
        number, d = divmod(number, 64)
        code = digits[d] + code
    assert value(spark, F.unix_millis(urls.shortcode_time(said(code)))) == wanted
    assert value(spark, urls.shortcode_time(said("a!b"))) is None
    assert value(spark, F.unix_seconds(urls.video_time(said(str(1700000000 * 2**32 + 9))))) == 1700000000
    assert value(spark, urls.video_time(said("123"))) is None


def test_text(spark):
    assert value(spark, text.clean_ui_noise(said(" <b>Alle Anzeigen</b> *** Pizza &amp; Wein – "))) == "Pizza & Wein"
    assert value(spark, text.clean_text(said(None))) == ""
    assert value(spark, text.repair_mojibake(said("FrÃ¼hstÃ¼ck"))) == "Frühstück"
    assert value(spark, text.repair_mojibake(said("Frühstück"))) == "Frühstück"
    assert value(spark, text.fold(said("Café Größe"))) == "cafe große"
    assert value(spark, text.distinct_ci(F.array(said("A"), said("a"), said(None), said(""), said("B"), said("C")), 2)) == ["A", "B"]
    assert value(spark, text.caption(said('12 likes, 3 comments - a.b on May 1: "Gratis Eis"'))) == "Gratis Eis"
    assert value(spark, text.price(said("nur 3,50 € heute"))) == 3.5 and value(spark, text.percent(said("minus 20%"))) == 20.0
    assert value(spark, text.price(said("gratis"))) is None
    assert value(spark, text.district(said("Gasse 1, 1070 Wien"))) == "7. Bezirk" and value(spark, text.district(said("1990"))) == ""
    assert value(spark, text.handle(said("@Some.One_1"))) == "some.one_1" and value(spark, text.handle(said("explore"))) == ""


def test_rules(spark):
    kinds = (rules.Rule("draw", ("prize draw", "raffle")), rules.Rule("pair", ("2 for 1", "1+1")), rules.Rule("cut", ("off", "sale"), unless=("free",)), rules.Rule("gift", ("free",), also=("today",)))
    for said_text, kind in (("Raffle: 1+1", "draw"), ("now 2 for 1!", "pair"), ("20% off", "cut"), ("free, 20% off today", "gift"), ("free", "event"), ("offer", "event"), (None, "event")):
        assert value(spark, rules.offer_type(said(said_text), said("Event"), kinds)) == kind, said_text
    words, aliases = (rules.Rule("tea", ("tee", "chai")), rules.Rule("tech", ("phone",))), {"food": "meals", "any": "misc"}
    for given, said_text, want in (("Food", "chai", "meals"), ("any", "Phone", "tech"), ("", "Teegarten", "none"), ("misc", "Tee trinken", "tea"), (None, None, "none"), ("other", "chai", "other"), ("Food", "strictly secret", "hidden")):
        assert value(spark, rules.category(said(given), said(said_text), words, aliases, ("misc",), (rules.Rule("hidden", ("secret",)),), "none")) == want, said_text


def test_backed_rank(spark):
    ranks = validity.Ranks(fields={"end": 50}, other=20, sources=(("^page", 80),), confidence={"high": 5, "low": -60}, doubtful=(("guess", 10),))
    for where, source, confidence, want in (("end", "", "high", 55), ("end", "page.x", None, 80), ("x", "", "low", 1), ("end", "page guess", "high", 10), (None, None, None, 20)):
        assert value(spark, validity.backed_rank(said(where), said(source), said(confidence), ranks)) == want


def test_envelopes(spark):
    files = spark.createDataFrame([("a/deals-pending-x.json", '{"deals":[{"id":"1","hot":true},{"id":"2"}]}'), ("a/deals-pending-y.json", '[{"id":"3","votes":4}]'), ("a/deals-pending-z.json", "{broken"), ("a/other.json", '[{"id":"9"}]')], "path string, body string")
    got = landed.pending(files, excluded=["deals-pending-q.json"]).orderBy("id").collect()
    assert [(r["source_key"], r["position"], r["id"]) for r in got] == [("x", 0, "1"), ("x", 1, "2"), ("y", 0, "3")]
    assert got[0]["hot"] is True and got[2]["votes"] == 4


def test_feeds_and_pages(spark):
    feed = spark.createDataFrame([("<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><pubDate>Mon</pubDate></item><item><title>C</title></item></rss>",)], "body string")
    assert [(r["title"], r["link"]) for r in landed.rss_items(feed).collect()] == [("A & B", "http://x/1"), ("C", "")]
    page = said('<title>T</title><meta content="D" property="og:description"><h1>H</h1><time datetime="2026-01-02">x</time><script type="application/ld+json">{"a":{"startDate":"2026-02-03"}}</script>')
    assert value(spark, landed.meta(page, "og:description")) == "D" and value(spark, landed.heading(page)) == "H"
    assert value(spark, landed.times(page)) == ["2026-01-02"]
    assert [tuple(d) for d in value(spark, landed.linked_data_dates(page))] == [("startDate", "2026-02-03")]


def test_media(spark):
    body = '{"data":[{"id":"1","caption":"c","media_type":"IMAGE","media_url":"u"},{"id":"2","children":{"data":[{"id":"3","media_url":"v"},{"id":"4"}]}}]}'
    got = landed.media_items(spark.createDataFrame([("h", body)], "tag string, body string")).orderBy("id").collect()
    assert [[a["id"] for a in r["assets"]] for r in got] == [["1"], ["3", "4"]] and got[0]["tag"] == "h"


def test_merges_do_not_depend_on_row_order(spark):
    rows = [(1, "k", "short", 5.0, "s1"), (2, "k", "the longest", 1.0, "s2"), (3, "k", "x", 9.0, "s1"), (4, "other", "y", 0.0, None)]
    schema = "id long, key string, title string, score double, source string"
    results = []
    for order in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        merged = dedup.merge_evidence(spark.createDataFrame(order, schema), "key", "score", "id", ["title"], ["score"], ["id"], "source")
        results.append(sorted(map(tuple, merged.collect())))
    assert results[0] == results[1] == results[2]
    assert results[0][0][:3] == ("k", 3, "the longest")


def test_anti_joins_keep_rows_without_a_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, key string")
    assert sorted(r["id"] for r in joins.without_seen(rows, rows.where("id = 1"), "key").collect()) == [2, 3]
    assert sorted(r["id"] for r in joins.without_any_key(rows, F.array("key"), rows.where("id = 3").select("key"), "id").collect()) == [1, 2]


def test_fallback_fills_only_nulls(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id long, v string")
    right = spark.createDataFrame([(1, "q"), (2, "q")], "id long, v string")
    assert {r["id"]: r["v"] for r in joins.fallback(left, right, "id", ["v"]).collect()} == {1: "q", 2: "x", 3: None}
