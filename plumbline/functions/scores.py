"""Scores: arithmetic on the columns of one row, rounded half up and clamped where the formula says so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(score: Column) -> Column:
    """Rounded half up, within 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))).cast("double")


def health(c) -> Column:
    return clamped(c("unique_rate") * 22 + c("vienna_rate") * 22 + c("food_rate") * 20 + c("promo_rate") * 16 + c("fresh_rate") * 14 + (1 - c("missing_url_rate")) * 6)


def mission(c) -> Column:
    return clamped(c("food_rate") * 35 + c("promo_rate") * 28 + c("fresh_rate") * 22 + c("vienna_rate") * 15)


def coverage(c) -> Column:
    share = lambda n: F.when(c(f"max_{n}") > 0, c(n) / c(f"max_{n}")).otherwise(0.0)
    return clamped(share("total") * 38 + share("n_unique") * 24 + share("fresh") * 23 + (c("vienna_rate") + c("food_rate") + c("promo_rate")) / 3 * 15)


def precision(c) -> Column:
    return clamped(c("vienna_rate") * 28 + c("food_rate") * 24 + c("promo_rate") * 22 + c("fresh_rate") * 12 + (1 - c("duplicate_rate")) * 8 + (1 - c("missing_url_rate")) * 6)


def weight(c) -> Column:
    return clamped(c("health") * 0.28 + c("mission") * 0.32 + c("coverage") * 0.2 + c("precision") * 0.2)


def registry(c) -> Column:
    capped = lambda name, each, most: F.least(c(name) * each, F.lit(most))
    return clamped((capped("occurrences", 10, 40) + capped("live", 12, 24) + capped("promo", 8, 16) + capped("food", 8, 16) + capped("vienna", 4, 8) + F.when(c("watchlist"), 10).otherwise(0) + capped("historical_vienna", 14, 28) + capped("historical_address", 8, 16)).cast("double"))


def registry_priority(c) -> Column:
    rate = lambda name: c(name) / c("occurrences")
    average = F.when(c("total_quality") > 0, rate("total_quality")).otherwise(0.0)
    return F.when(c("occurrences") == 0, 0.0).otherwise(clamped(registry(c) * 0.42 + rate("mission") * 26 + rate("fresh") * 18 + rate("live") * 8 + F.least(average, F.lit(100.0)) * 0.06))


def daily(food: Column, strong: Column, percent: Column, hot: Column, new: Column, free: Column, votes: Column) -> Column:
    add = lambda test, points: F.when(test, points).otherwise(F.lit(0))
    return add(food, F.lit(120)) + add(strong, 90 + F.coalesce(percent, F.lit(0))) + add(hot, F.lit(25)) + add(new, F.lit(8)) + add(free, F.lit(18)) + F.least(F.lit(25), F.coalesce(votes, F.lit(0)))


# Points of categories and types for the featured pick.
CATEGORY_POINTS = {"essen": 22, "kaffee": 20, "supermarkt": 16, "shopping": 12, "beauty": 10, "fitness": 10, "reisen": 8, "kultur": 6, "events": 6, "kirche": -20, "gottesdienste": -20, "gemeinde": -18}
TYPE_POINTS = {"gratis": 30, "bogo": 24, "rabatt": 18, "gutschein": 14}


def points(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(value)), F.lit(0))


def featured(kind: Column, category: Column, brand: Column, weak_brand: Column, title: Column, description: Column, has_url: Column, age_days: Column) -> Column:
    when = lambda test, n: F.when(test, n).otherwise(0)
    fixed = points(kind, TYPE_POINTS) + points(category, CATEGORY_POINTS) + when((brand != "") & ~weak_brand, 12) - when(weak_brand, 18)
    return fixed + when(F.char_length(title) >= 14, 8) + when(F.char_length(description) >= 28, 6) + when(has_url, 6) + F.coalesce(F.greatest(F.lit(0), 18 - age_days), F.lit(0))


def evidence(publication_rank: Column, has_place: Column, expires: Column, as_of: Column, has_post: Column, quality: Column) -> Column:
    expiry = F.when(expires.isNull(), 0).when(expires >= as_of, 22).otherwise(4)
    return publication_rank * 30 + F.when(has_place, 35).otherwise(0) + expiry + F.when(has_post, 12).otherwise(0) + F.least(F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 10


def search_rank(kind: Column, hot: Column, quality: Column, priority: Column) -> Column:
    return F.when(kind == "gratis", 40).when(kind == "bogo", 30).otherwise(20) + F.when(hot, 15).otherwise(0) + F.least(F.coalesce(quality, F.lit(0.0)), F.lit(100.0)) / 5 + F.least(F.coalesce(priority, F.lit(0)), F.lit(5))


def source_performance(runs: Column, hits: Column, links: Column) -> Column:
    return F.when(runs > 0, hits / runs * 100 + F.least(links / runs / 4, F.lit(20.0))).otherwise(0.0)


def reasoned(parts: Sequence[tuple[Column, int, str]]) -> Column:
    """(score, reasons): the points of the parts that hold, clamped, and what they are for, in order."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(points).alias("points"), F.lit(label).alias("label"))) for test, points, label in parts]))
    total = F.aggregate(held, F.lit(0), lambda a, x: a + x["points"])
    return F.struct(clamped(total.cast("double")).alias("score"), F.transform(held, lambda x: x["label"]).alias("reasons"))


def capped_hits(counts: Mapping[str, Column], each: Mapping[str, int], most: Mapping[str, int]) -> Column:
    """Points for hits of several kinds: so many each, up to so many a kind; clamped in all."""
    parts = [F.least(F.coalesce(counts[k], F.lit(0)) * each[k], F.lit(most[k])) for k in counts]
    return clamped(sum(parts[1:], parts[0]).cast("double"))


def quality(brand: Column, title: Column, description: Column, category: Column, generic: Sequence[str]) -> Column:
    """A record's quality by what it says: points for a brand and title that are not generic, a title of fair length, a
    description, and a category."""
    named = lambda c: F.coalesce((c != "") & ~F.lower(c).isin(*generic), F.lit(False))
    parts = [(named(brand), 25), (named(title), 20), (F.char_length(title).between(12, 90), 15), (F.char_length(description) >= 40, 25), (named(category), 15)]
    return clamped(sum((F.when(F.coalesce(test, F.lit(False)), F.lit(n)).otherwise(0) for test, n in parts), F.lit(0)).cast("double"))
