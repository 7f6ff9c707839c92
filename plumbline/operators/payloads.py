"""Contracts of nested payloads: VARIANT values walked by path; what is broken is named by payload, path and rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import join_unique
from plumbline.workspace import store


@dataclass(frozen=True)
class Field:
    """A value below an item: its path ('$.evidence.source'), its SQL type, whether it must be there, and tests by rule name."""

    path: str
    kind: str = "string"
    required: bool = True
    tests: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class Together:
    """A test of several values of an item: it gets a function from (path, type) to the value; a null outcome holds."""

    rule: str
    path: str
    test: Callable[[Callable[[str, str], Column]], Column]


@dataclass(frozen=True)
class Contract:
    """What payloads of one kind promise: a list of items at `items`, how many there are (at `total`), the items' fields
    and joint tests, paths whose values come once (`unique`: in a payload; `unique_overall`: in all of them), and pairs
    (path, list, path in it, rule) of values that must not stand in another list of the payload as well."""

    items: str
    fields: tuple[Field, ...]
    total: str | None = None
    together: tuple[Together, ...] = ()
    unique: tuple[str, ...] = ()
    unique_overall: tuple[str, ...] = ()
    apart: tuple[tuple[str, str, str, str], ...] = ()


def exploded(parsed: DataFrame, key: str, path: str) -> DataFrame:
    """(key, place, item) for each element of the array at `path` of the VARIANT column `v`; anything else has no elements."""
    below = parsed.select(key, F.try_variant_get("v", path, "array<variant>").alias("_items"))
    return below.select(key, F.posexplode("_items").alias("place", "item"))


def _value(item: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, path, kind)


def _held(payload: str, items: str, path: str) -> Column:
    """The values at `path` that the items of the list at `items` have, as an array."""
    each = F.transform(F.try_variant_get(payload, items, "array<variant>"), lambda x: F.try_variant_get(x, path, "string"))
    return F.filter(each, lambda x: x.isNotNull())


def _breaches(f: Field) -> list[Column]:
    raw = _value("item", f.path, "variant")
    missing = raw.isNull() | F.is_variant_null(raw)
    value = _value("item", f.path, f.kind)
    broken = lambda rule: F.struct(F.lit(f.path[1:]).alias("below"), F.lit(rule).alias("rule"))
    out = [F.when(~missing & value.isNull(), broken("type"))]
    if f.required:
        out.append(F.when(missing, broken("missing")))
    return out + [F.when(value.isNotNull() & ~F.coalesce(test(value), F.lit(False)), broken(name)) for name, test in f.tests.items()]


def broken_payloads(rows: DataFrame, key: str, payload: str, contract: Contract) -> DataFrame:
    """(key, path, rule) for every broken rule of every payload; none means that the contract holds.

    `payload` is JSON text and `key` names it uniquely. Text that is no JSON (null too) breaks 'json' at '$'; a list that is
    missing breaks 'missing' at its path; a total that differs from the number of items, or is none, breaks 'total'. Fields
    break 'missing' (absent or JSON null), 'type', or a test by its name; of values that may come once, all but the first
    (by key, then place) break 'repeated'. Each payload is parsed once and read by path; of its items what they break and
    the values that are compared are kept. Values that repeat are found by one aggregation whose result the rows meet by
    join_unique, so that a value that a third of all items hold fills no task; of what is compared within a payload only
    payloads take part that have a repeated or a clashing value, which their row tells by itself. No rows give no rows.
    """
    parsed = store(rows.select(key, F.try_parse_json(payload).alias("v")), "payloads")
    named = lambda below: F.concat(F.lit(f"{contract.items}["), F.col("place").cast("string"), F.lit("]"), below).alias("path")

    n_items = F.size(F.try_variant_get("v", contract.items, "array<variant>"))
    at = lambda path, rule: F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))
    listed = F.try_variant_get("v", contract.items, "array<variant>").isNotNull()
    whole = [F.when(F.col("v").isNull(), at("$", "json")), F.when(F.col("v").isNotNull() & ~listed, at(contract.items, "missing"))]
    if contract.total:
        total = F.try_variant_get("v", contract.total, "long")
        whole.append(F.when(listed & ~F.coalesce(total == n_items, F.lit(False)), at(contract.total, "total")))
    out = parsed.select(key, F.explode(F.array_compact(F.array(*whole))).alias("b")).select(key, "b.path", "b.rule")

    each = [b for f in contract.fields for b in _breaches(f)]
    get = lambda path, kind="string": _value("item", path, kind)
    each += [F.when(~F.coalesce(t.test(get), F.lit(True)), F.struct(F.lit(t.path[1:]).alias("below"), F.lit(t.rule).alias("rule"))) for t in contract.together]
    compared = list(dict.fromkeys([*contract.unique, *contract.unique_overall, *(a[0] for a in contract.apart)]))
    own = [F.size(F.array_distinct(_held("v", contract.items, p))) < F.size(_held("v", contract.items, p)) for p in contract.unique]
    own += [F.arrays_overlap(_held("v", contract.items, p), _held("v", other, other_path)) for p, other, other_path, _ in contract.apart]
    flags = [F.coalesce(x, F.lit(False)).alias(f"_own_{i}") for i, x in enumerate(own)]
    flagged = parsed.select(key, *flags, F.try_variant_get("v", contract.items, "array<variant>").alias("_items"))
    items = flagged.select(key, *[f"_own_{i}" for i in range(len(own))], F.posexplode("_items").alias("place", "item"))
    found = [F.array_compact(F.array(*each)).alias("_broken")] if each else []
    items = store(items.select(key, "place", *[f"_own_{i}" for i in range(len(own))], *found, *[_value("item", p).alias(f"_value_{i}") for i, p in enumerate(compared)]), "payload-items")
    if each:
        out = out.union(items.select(key, "place", F.explode("_broken").alias("b")).select(key, named(F.col("b.below")), "b.rule"))

    values = lambda path, which=F.lit(True): items.where(which).select(key, "place", F.col(f"_value_{compared.index(path)}").alias("_value")).where("_value IS NOT NULL")
    scopes = [*((p, [key], F.col(f"_own_{i}")) for i, p in enumerate(contract.unique)), *((p, [], F.lit(True)) for p in contract.unique_overall)]
    for path, scope, which in scopes:
        held, on = values(path, which), [*scope, "_value"]
        repeated = held.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "place")).alias("_first")).where("n > 1")
        repeated = store(repeated, "payload-repeated")
        met = join_unique(held, repeated.select(*on, "_first"), on, repeated.select(*on, "n"))
        out = out.union(met.where(F.struct(key, "place") != F.col("_first")).select(key, named(F.lit(path[1:])), F.lit("repeated")))

    for i, (path, other, other_path, rule) in enumerate(contract.apart, len(contract.unique)):
        others = store(exploded(parsed, key, other).select(key, _value("item", other_path).alias("_value")).where("_value IS NOT NULL").distinct(), "payload-others")
        out = out.union(join_unique(values(path, F.col(f"_own_{i}")), others, [key, "_value"]).select(key, named(F.lit(path[1:])), F.lit(rule)))
    return out
