"""Decisions with reasons: ranked candidates, gates, and what they decide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranks:
    """Ranks by field, by pattern of the source (the first that is found), and what confidence adds."""

    fields: Mapping[str, int]
    other: int
    sources: Sequence[tuple[str, int]] = ()
    confidence: Mapping[str, int] = field(default_factory=dict)
    doubtful: Sequence[tuple[str, int]] = ()


def best_candidate(*candidates: tuple[Column, Column, str]) -> Column:
    """(rank, moment, source) of the candidate with the highest rank, then the latest moment; null without a moment."""
    rows = F.array(*[F.when(moment.isNotNull(), F.struct(rank.alias("rank"), moment.alias("moment"), F.lit(name).alias("source"))) for rank, moment, name in candidates])
    return F.array_max(F.array_compact(rows))


def backed_rank(where: Column, source: Column, confidence: Column, ranks: Ranks) -> Column:
    """How well a statement is backed: the rank of the field it stands in or, if higher, of the class of its source, moved by
    its confidence; at least 1. A source of a `doubtful` class has that rank whatever else holds."""
    base = F.coalesce(*[F.when(where == name, F.lit(rank)) for name, rank in ranks.fields.items()], F.lit(ranks.other))
    classes = [F.when(source.rlike(pattern), F.lit(rank)) for pattern, rank in ranks.sources]
    named = F.greatest(base, F.coalesce(*classes, F.lit(0)))
    moved = named + F.coalesce(*[F.when(confidence == name, F.lit(step)) for name, step in ranks.confidence.items()], F.lit(0))
    doubtful = F.coalesce(*[F.when(source.rlike(pattern), F.lit(rank)) for pattern, rank in ranks.doubtful], F.lit(None).cast("int"))
    return F.coalesce(doubtful, F.greatest(F.lit(1), moved))


def decision(gates: list[tuple[Column, str]], notes: list[tuple[Column, str]]) -> Column:
    """(allowed, reasons, warnings): every gate that holds gives a reason, and any reason blocks."""
    listed = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules]))
    reasons = listed(gates)
    return F.struct((F.size(reasons) == 0).alias("allowed"), reasons.alias("reasons"), listed(notes).alias("warnings"))


def first_reason(gates: list[tuple[Column, str]]) -> Column:
    """The first gate that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in gates])


def url_status(status: Column) -> Column:
    """invalid, transient, redirect or ok by the code of a landed check."""
    # Codes that mean gone, and codes that mean try again.
    return F.when(status.isin(404, 410, 451), "invalid").when(status.isin(401, 403, 408, 409, 423, 425, 429, 500, 502, 503, 504), "transient").when(status.between(300, 399), "redirect").when(status.between(200, 299), "ok").otherwise("unknown")


def in_vienna(latitude: Column, longitude: Column) -> Column:
    # The box that counts as the city.
    return latitude.between(48.10, 48.35) & longitude.between(16.15, 16.60)


def excluded(text: Column, host: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The label of the first rule (label, text pattern, host pattern) of which either pattern is found; null without any."""
    found = lambda c, p: c.rlike(f"(?i){p}") if p else F.lit(False)
    return F.coalesce(*[F.when(F.coalesce(found(text, t), F.lit(False)) | F.coalesce(found(host, h), F.lit(False)), F.lit(name)) for name, t, h in rules])


def place_evidence(steps: Sequence[tuple[str, Column, Column]]) -> Column:
    """(type, value) of the first step (type, condition, value) that holds: ordered evidence for a place."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))) for kind, test, value in steps])


def in_box(latitude: Column, longitude: Column, south: float, north: float, west: float, east: float) -> Column:
    return latitude.between(south, north) & longitude.between(west, east)


def concrete_offer(text: Column, price: Column, noise: Sequence[str], signs: Sequence[tuple[str, str]], most_price: float) -> Column:
    """Why a text is a concrete offer: the first sign (label, pattern) found after the `noise` patterns are out, or a price of
    at most `most_price`; null if it is none."""
    plain = F.coalesce(text, F.lit(""))
    for pattern in noise:
        plain = F.regexp_replace(plain, f"(?i){pattern}", " ")
    return F.coalesce(*[F.when(plain.rlike(f"(?i){p}"), F.lit(label)) for label, p in signs], F.when(price <= most_price, "price"))


def stale_relative(is_relative: Column, published: Column, as_of: Column) -> Column:
    """An offer for the day of its publication is over the day after; one without a publication cannot be trusted."""
    return F.when(is_relative & published.isNull(), "relative without a day").when(is_relative & (published.cast("date") < as_of.cast("date")), "relative and past")


def may_remove(switches: Sequence[Column], reason: Column, allowed: Sequence[str], confidence: Column, least: float) -> Column:
    """Whether an automatic removal may be applied: all switches on, a reason among those allowed, enough confidence."""
    on = F.lit(True)
    for switch in switches:
        on = on & F.coalesce(switch, F.lit(False))
    return on & F.coalesce(reason.isin(*allowed), F.lit(False)) & F.coalesce(confidence >= least, F.lit(False))


def weak_source(runs: Column, hits: Column, links: Column, least_runs: int = 6, least_links: float = 2.0) -> Column:
    """Whether a source is skipped: enough runs, no hits, and few links a run."""
    return (runs >= least_runs) & (hits == 0) & (links < least_links * runs)


def runs_on(as_of: Column, weekday: int) -> Column:
    """Whether a weekly run is due: 1 is Sunday, 7 is Saturday."""
    return F.dayofweek(as_of) == weekday


def record(rows, fields: Mapping[str, Column], derived: Mapping[str, Column], gates: Sequence[tuple[Column, str]]):
    """One normalised record a row, in one projection: cleaned `fields`, then columns `derived` from them, then `rejected`,
    the first gate that holds. Derived columns and gates may name the fields; Catalyst folds the projections into one."""
    kept = [c for c in rows.columns if c not in fields and c not in derived]
    cleaned = rows.select(*kept, *[c.alias(n) for n, c in fields.items()])
    filled = cleaned.select("*", *[c.alias(n) for n, c in derived.items()])
    return filled.withColumn("rejected", first_reason(list(gates)))
