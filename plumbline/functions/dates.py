"""Dates in offers: parsing, year inference, windows, local calendar keys and ages. All arithmetic is in UTC unless named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import collapse

# The local calendar, the look-ahead of year inference, and the limits of freshness.
ZONE = "Europe/Vienna"
ROLL_DAYS, SKEW_MINUTES, FRESH_HOURS = 45, 5, 72
# Month names of the parsers, in order.
MONTHS = ("j[aä]nner|januar|january", "februar|february", "m[aä]rz|maerz|march", "april", "mai|may", "juni|june", "juli|july", "august", "september", "oktober|october", "november", "dezember|december")
# Phrases that name no date.
VAGUE = r"(?i)kurzfristig|solange der vorrat|siehe |ganzt[aä]gig|gutschein-abh[aä]ngig|laufend|unbekannt|auf widerruf|jederzeit|dauerhaft|variabel"


def iso_or_epoch(value: Column) -> Column:
    """A timestamp from 10 to 13 digits (seconds below 1e12, else milliseconds) or from ISO text; null otherwise."""
    text = collapse(value)
    number = F.when(text.rlike("^[0-9]{10,13}$"), text).cast("bigint")
    return F.coalesce(F.timestamp_millis(F.when(number < 1000000000000, number * 1000).otherwise(number)), F.try_to_timestamp(F.when(number.isNull(), F.nullif(text, F.lit("")))))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none such."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use its argument often: the value is computed once."""
    return F.transform(F.array(value), f)[0]


def dmy(value: Column) -> Column:
    """The first day.month.year (or day/month/year) in the text as a date; two-digit years are of this century."""
    return _dmy(collapse(value))


def _dmy(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2}[./][0-9]{1,2}[./](?:[0-9]{4}|[0-9]{2}))(?:[^0-9]|$)", 1)
    parts = F.transform(F.split(F.nullif(found, F.lit("")), "[./]"), lambda p: p.cast("int"))
    return bound(parts, lambda p: make_date(p[2] + F.when(p[2] < 100, 2000).otherwise(0), p[1], p[0]))


def iso_date(value: Column) -> Column:
    return _iso(collapse(value))


def _iso(text: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")


def month_number(value: Column) -> Column:
    """The number of the first month named in the text; null without one."""
    text = F.lower(collapse(value))
    return F.coalesce(*[F.when(text.rlike(rf"(?:^|[^\p{{L}}])(?:{m})(?:[^\p{{L}}]|$)"), F.lit(i)) for i, m in enumerate(MONTHS, 1)])


def single_year(month: Column, day: Column, today: Column) -> Column:
    """The year of a day without one: this year's, but the next one's where this year's is past and the next is near."""
    this, following = make_date(F.year(today), month, day), make_date(F.year(today) + 1, month, day)
    return F.when((this < today) & (F.date_diff(following, today) <= ROLL_DAYS), F.year(today) + 1).otherwise(F.year(today))


def month_year(month: Column, today: Column) -> Column:
    """The year of a month without one: January and February belong to the next one late in a year."""
    return F.year(today) + F.when((F.month(today) >= 11) & (month <= 2), 1).otherwise(0)


def day_month(value: Column, today: Column) -> Column:
    """A day.month without a year, by single_year."""
    return _day_month(collapse(value), today)


def _day_month(text: Column, today: Column) -> Column:
    found = F.regexp_extract(text, r"(?:^|[^0-9.])([0-9]{1,2}\.[0-9]{1,2})(?:\.?(?:[^0-9]|$))", 1)
    parts = F.transform(F.split(F.nullif(found, F.lit("")), r"\."), lambda p: p.cast("int"))
    return bound(parts, lambda p: make_date(single_year(p[1], p[0], today), p[1], p[0]))


def plausible(day: Column, today: Column) -> Column:
    """A date before 2010 and over five years back is taken to be of this year."""
    return F.when((F.year(day) < 2010) & (F.year(today) - F.year(day) >= 5), make_date(F.year(today), F.month(day), F.dayofmonth(day))).otherwise(day)


def end_of_day(day: Column) -> Column:
    return F.to_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59.999")))


def is_vague(value: Column) -> Column:
    return (iso_date(value).isNull() & dmy(value).isNull()) & ((collapse(value) == "") | collapse(value).rlike(VAGUE))


def shape(value: Column, today: Column) -> Column:
    """What kind of validity a text states: (kind, valid_on, valid_from, valid_until, confidence)."""
    until = r"(?:bis|-|–|to|until) *([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})"

    def read(text: Column) -> Column:
        return F.struct(text.alias("text"), F.coalesce(_dmy(text), _iso(text), _day_month(text, today)).alias("first"), _dmy(F.regexp_extract(text, until, 1)).alias("last"))

    return bound(F.lower(collapse(value)), lambda text: bound(read(text), lambda parts: _shape(parts, today)))


def _shape(parts: Column, today: Column) -> Column:
    text, first, last = (parts[name] for name in ("text", "first", "last"))
    number = month_number(text)  # reached only where no date is found
    month = make_date(month_year(number, today), number, F.lit(1))
    none = F.lit(None).cast("date")

    def of(kind: str, on: Column = none, begin: Column = none, end: Column = none, confidence: str = "high") -> Column:
        return F.struct(F.lit(kind).alias("kind"), on.alias("valid_on"), begin.alias("valid_from"), end.alias("valid_until"), F.lit(confidence).alias("confidence"))

    return (
        F.when(text == "", of("unknown", confidence="low"))
        .when(text.rlike(r"jeden|jede|jedes|every|täglich|daily|wöchentlich"), of("recurring", confidence="medium"))
        .when(last.isNotNull() & (first < last), of("range", begin=first, end=last))
        .when(first.isNotNull() & text.rlike(r"^(?:ab|seit|from|startet)\b"), of("start", begin=first))
        .when(first.isNotNull() & text.rlike(r"bis|endet|until|through|gültig"), of("end", end=first))
        .when(first.isNotNull(), of("single", on=first))
        .when(month.isNotNull(), of("month", begin=month, end=F.last_day(month), confidence="medium"))
        .otherwise(of("unknown", confidence="low"))
    )


def local_day(moment: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(moment, zone))


def week_key(moment: Column, zone: str = ZONE) -> Column:
    """The Monday of the local week, as text."""
    day = local_day(moment, zone)
    return F.date_sub(day, F.weekday(day)).cast("string")


def six_hour_shard(moment: Column, shards: int) -> Column:
    return F.floor(F.unix_seconds(moment) / 21600) % shards


def elapsed_days(moment: Column, as_of: Column) -> Column:
    """Whole days passed, none below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_seconds(as_of) - F.unix_seconds(moment)) / 86400))


def calendar_days(moment: Column, as_of: Column) -> Column:
    """Whole UTC calendar days apart, none below 0."""
    return F.greatest(F.lit(0), F.date_diff(F.to_date(as_of), F.to_date(moment)))


def is_fresh(published: Column, approved: Column, expires: Column, as_of: Column, hours: int = FRESH_HOURS) -> Column:
    """Published (else approved) within the hours before as_of, at most SKEW_MINUTES ahead of it, and not expired."""
    seconds = F.unix_seconds(as_of) - F.unix_seconds(F.coalesce(published, approved))
    return F.coalesce(seconds.between(-60 * SKEW_MINUTES, 3600 * hours), F.lit(False)) & F.coalesce(expires >= as_of, F.lit(True))


def relative_age(value: Column, as_of: Column) -> Column:
    """The moment that '5h ago' or 'vor 3 Tagen' names."""
    text = F.lower(collapse(value))
    number = F.nullif(F.regexp_extract(text, r"([0-9]+) *(?:h|min|m|d|w|stunden?|minuten?|tage?n?|wochen?|hours?|minutes?|days?|weeks?)\b", 1), F.lit("")).cast("bigint")
    unit = F.regexp_extract(text, r"[0-9]+ *([a-z])", 1)
    seconds = F.when(unit.isin("h", "s"), 3600).when(unit == "m", 60).when(unit.isin("d", "t"), 86400).when(unit == "w", 604800)
    return F.timestamp_seconds(F.unix_seconds(as_of) - number * seconds)
