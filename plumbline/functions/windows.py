"""When an offer holds, read from days without a year, from relative words, and from what is said of weekdays. Words are
arguments; days are those of the given calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.dates import make_date
from plumbline.functions.rules import holds_word


def range_years(begin_month: Column, begin_day: Column, end_month: Column, end_day: Column, today: Column, ahead: int = 45) -> Column:
    """(begin, end) of a span of days without years. A span that runs over the new year ends in the year after it begins; it
    has begun last year if it still runs, and belongs to this year's end only once its begin is `ahead` days away or less.
    A span within a year that is over comes next year if that begin is at most `ahead` days away, and is past otherwise."""
    year = F.year(today)
    begin, end = lambda y: make_date(y, begin_month, begin_day), lambda y: make_date(y, end_month, end_day)
    over_new_year = (end_month < begin_month) | (end_month == begin_month) & (end_day < begin_day)
    span = lambda y, step: F.struct(begin(y).alias("begin"), end(y + step).alias("end"))
    crossing = F.when(end(year) >= today, span(year - 1, 1)).when(F.date_diff(begin(year), today) <= ahead, span(year, 1)).otherwise(span(year - 1, 1))
    within = F.when((end(year) < today) & (F.date_diff(begin(year + 1), today) <= ahead), span(year + 1, 0)).otherwise(span(year, 0))
    return F.when(over_new_year, crossing).otherwise(within)


def weekend_end(day: Column) -> Column:
    """The Sunday on or after the day."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def first_sunday(day: Column) -> Column:
    """The first Sunday of the day's month."""
    return F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "SUN")


def relative_end(text: Column, published: Column, days: Mapping[str, int], weekdays: Mapping[str, str], weekend: Sequence[str]) -> Column:
    """The last day of an offer that names it by a word, counted from the day of publication: words for a number of days on,
    then words for the weekend, then names of weekdays (the next one, the day itself included). Null without any."""
    by_days = [F.when(holds_word(text, [word]), F.date_add(published, n)) for word, n in days.items()]
    ends = F.when(holds_word(text, list(weekend)), weekend_end(published))
    by_name = [F.when(holds_word(text, [word]), F.next_day(F.date_sub(published, 1), day)) for word, day in weekdays.items()]
    return F.coalesce(*by_days, ends, *by_name)


def recurring(text: Column, every: Sequence[str], weekdays: Sequence[str], offer: Sequence[str]) -> Column:
    """Whether one sentence of the text names a repeating weekday and an offer."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"[.!?;\n]+")
    return F.exists(sentences, lambda s: holds_word(s, every) & holds_word(s, weekdays) & holds_word(s, offer))


def only_past(text: Column, past: Sequence[str], still: Sequence[str]) -> Column:
    """Whether the text speaks of a past day only."""
    return holds_word(text, past) & ~holds_word(text, still)


def repaired_publication(published: Column, approved: Column, as_of: Column, trusted: Column, most_ahead_hours: int = 24) -> Column:
    """The publication where it is trusted and not in the future, else the approval where that is not, else null."""
    limit = as_of + F.make_dt_interval(hours=F.lit(most_ahead_hours))
    return F.coalesce(F.when(F.coalesce(trusted, F.lit(False)) & (published <= limit), published), F.when(approved <= limit, approved))


def most_age_days(text: Column, kind: Column, by_text: Sequence[tuple[str, int]], by_kind: Mapping[str, int], default: int) -> Column:
    """How many days old a candidate may be: by the first pattern of its text, else by its kind."""
    said = [F.when(text.rlike(f"(?i){p}"), F.lit(n)) for p, n in by_text]
    return F.coalesce(*said, *[F.when(kind == k, F.lit(n)) for k, n in by_kind.items()], F.lit(default))


def age_gate(published: Column, as_of: Column, most_days: Column, ahead_hours: int = 36) -> Column:
    """Why a post's age takes it out: 'undated', 'future' (more than `ahead_hours` ahead) or 'too old'; null if it may stay."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(published)
    return F.when(published.isNull(), "undated").when(seconds < -ahead_hours * 3600, "future").when(seconds > most_days * 86400, "too old")


def timing(text: Column, published: Column, valid_until: Column, relative: Column, as_of: Column, most_days: int) -> Column:
    """All that decides whether an offer is timely, as one struct: its age, its end and where that comes from, and the verdict."""
    age = F.date_diff(as_of.cast("date"), published.cast("date"))
    end = F.coalesce(valid_until, relative)
    source = F.when(valid_until.isNotNull(), "stated").when(relative.isNotNull(), "relative").otherwise("none")
    fresh, running = F.coalesce(age.between(0, most_days), F.lit(False)), F.coalesce(end >= as_of.cast("date"), F.lit(False))
    why = F.when(end < as_of.cast("date"), "over").when(running, "running").when(fresh, "fresh").when(age.isNull(), "undated").otherwise("old")
    return F.struct(age.alias("age_days"), end.alias("end"), source.alias("end_source"), fresh.alias("is_fresh"), running.alias("is_running"), why.isin("running", "fresh").alias("eligible"), why.alias("why"))
