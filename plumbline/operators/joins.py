"""Lookups, vetoes, overlays and merges of relations. Sides are left to Spark to broadcast where their size is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.workspace import store


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


#: A key is hot if it holds more than one row in HOT of a table, so that a table has less than HOT of them.
HOT = 1000
#: Moderation entries at most.
MOST_LISTED = 10_000


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], counts: DataFrame | None = None, n: str = "n", hot: int = HOT) -> DataFrame:
    """Inner join of rows with the one row that `unique` has for each key; a hot key's rows stay where they are.

    `counts` has the rows of each key (column `n`); without it they are counted. Rows of hot keys, of which there
    are less than `hot` whatever the tables' size, meet their row by broadcast; the others by a shuffle, in which no key
    fills a task. Keys are compared null-safely. `rows` is read more than once and should be stored.
    """
    counted = counts if counts is not None else rows.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    total = counted.agg(F.sum(n)).first()[0] or 0
    keys = store(counted.where(F.col(n) * hot > total).select(*on), "hot-keys")
    same = lambda a, b: [a[k].eqNullSafe(b[f"_h_{k}"]) for k in on]
    marked, kept = renamed(keys, "_h_"), [c for c in unique.columns if c not in on]
    hot_side = renamed(unique.join(F.broadcast(marked), same(unique, marked), "left_semi"), "_h_")
    other = renamed(unique.join(F.broadcast(marked), same(unique, marked), "left_anti"), "_h_")
    out = lambda df: df.select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in kept])
    cold = rows.join(F.broadcast(marked), same(rows, marked), "left_anti")
    return out(rows.join(F.broadcast(hot_side), same(rows, hot_side))).unionByName(out(cold.join(other.hint("merge"), same(cold, other))))


def enrich(left: DataFrame, right: DataFrame, on: str, fill: dict[str, str]) -> DataFrame:
    """Left lookup: column c of `left` becomes fill[c] of the match where there is one. Keys of `right` are unique."""
    side = renamed(right.select(on, *fill.values()), "_r_")
    joined = left.join(side, F.col(on) == F.col(f"_r_{on}"), "left")
    return joined.select(*[(F.coalesce(F.col(f"_r_{fill[c]}"), F.col(c)).alias(c) if c in fill else F.col(c)) for c in left.columns], *[F.col(f"_r_{r}").alias(c) for c, r in fill.items() if c not in left.columns], F.col(f"_r_{on}").isNotNull().alias("matched"))


def fallback(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left columns win; the match fills what is null."""
    side = renamed(right.select(on, *columns), "_r_")
    return left.join(side, F.col(on) == F.col(f"_r_{on}"), "left").select(*[(F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in columns else F.col(c)) for c in left.columns])


def without_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen; rows without a key stay."""
    return rows.join(seen.select(F.col(key).alias("_seen")).distinct(), F.col(key) == F.col("_seen"), "left_anti")


def without_any_key(rows: DataFrame, keys: Column, known: DataFrame, row_id: str) -> DataFrame:
    """Rows none of whose keys is among known(key). Keys travel as (row id, key), the rows only once."""
    hit = rows.select(F.col(row_id).alias("_hit"), F.explode(keys).alias("key")).join(known.select("key").distinct(), "key", "left_semi").select("_hit").distinct()
    return rows.join(hit, F.col(row_id) == F.col("_hit"), "left_anti")


def registered(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return rows.join(registry.select(key), key, "left_semi")


def overlay(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], allow_removals: bool) -> DataFrame:
    """Edits change, hide or restore rows by key.

    `edits` has key, hidden, and a column for each of `columns` (null: no change). A hidden row goes only where
    removals are allowed; an edit without a row restores it from its own values. `change` says what happened.
    """
    side = renamed(edits.select(key, "hidden", *columns), "_e_")
    joined = rows.select(key, *columns).join(side, F.col(key) == F.col(f"_e_{key}"), "full_outer")
    values = [F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) for c in columns]
    differs = [F.when(F.col(f"_e_{c}").isNotNull() & ~F.col(f"_e_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]
    changed = F.array_join(F.array_compact(F.array(*differs)), ",")
    hidden = F.coalesce(F.col("_e_hidden"), F.lit(False))
    change = F.when(F.col(key).isNull(), "restored").when(hidden, "kept hidden").when(changed != "", F.concat(F.lit("changed:"), changed)).otherwise("")
    out = joined.where(~(F.col(key).isNull() & hidden)).where(~hidden if allow_removals else F.lit(True))
    return out.select(F.coalesce(key, f"_e_{key}").alias(key), *values, change.alias("change"))


def three_way_merge(base: DataFrame, remote: DataFrame, local: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two changed copies of base: a deletion on either side wins, then local changes and additions, then remote ones."""
    b, r, lo = (renamed(df.select(key, *columns), p) for df, p in ((base, "_b_"), (remote, "_r_"), (local, "_l_")))
    joined = b.join(r, F.col(f"_b_{key}") == F.col(f"_r_{key}"), "full_outer").withColumn("_k", F.coalesce(f"_b_{key}", f"_r_{key}"))
    joined = joined.join(lo, F.col("_k") == F.col(f"_l_{key}"), "full_outer")
    has = lambda p: F.col(f"_{p}_{key}").isNotNull()
    edited = ~F.struct(*[f"_b_{c}" for c in columns]).eqNullSafe(F.struct(*[F.col(f"_l_{c}").alias(f"_b_{c}") for c in columns]))
    kept = F.when(has("b"), has("r") & has("l")).otherwise(has("r") | has("l"))
    use_local = has("l") & (~has("b") | edited)
    pick = lambda c: F.when(use_local, F.coalesce(f"_l_{c}", f"_r_{c}")).otherwise(F.col(f"_r_{c}")).alias(c)
    return joined.where(kept).select(F.coalesce("_k", f"_l_{key}").alias(key), *[pick(c) for c in columns])


def missing_references(rows: DataFrame, ids: Column, known: DataFrame, key: str) -> DataFrame:
    """The ids in each row's array that `known` lacks."""
    return rows.select(F.explode(ids).alias(key)).distinct().join(known.select(key).distinct(), key, "left_anti")


def moderated(rows: DataFrame, lists: DataFrame, row_id: str, url: str, signal: Column) -> DataFrame:
    """(row_id, reason) of rows that a moderation list blocks, by the first list that does.

    `lists` has (priority, kind, value); kinds id and url are matched whole by key joins, provider and text anywhere in
    the signal. Lists are kept by hand: at most MOST_LISTED words are sent to every task, and more are refused.
    """
    if (n := lists.count()) > MOST_LISTED:
        raise ValueError(f"{n} moderation entries; at most {MOST_LISTED} can be searched for in every text")
    narrow = rows.select(F.col(row_id).cast("string").alias("_id"), F.col(url).alias("_url"), F.lower(signal).alias("_signal"))
    entry = F.struct("priority", F.concat_ws(" ", F.col("kind"), F.col("value")).alias("reason"))
    named = lists.select("kind", "value", entry.alias("entry"))
    by_id = narrow.join(named.where("kind = 'id'"), F.col("_id") == F.col("value")).select("_id", "entry")
    by_url = narrow.join(named.where("kind = 'url'"), F.col("_url") == F.col("value")).select("_id", "entry")
    inside = narrow.join(F.broadcast(named.where("kind in ('provider', 'text')")), F.col("_signal").contains(F.lower("value"))).select("_id", "entry")
    return by_id.union(by_url).union(inside).groupBy("_id").agg(F.min("entry").alias("e")).select(F.col("_id").alias(row_id), F.col("e.reason").alias("reason"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before it; one window over the union, no pairs."""
    from pyspark.sql import Window

    kinds = {c: t for c, t in left.dtypes}
    rows = left.select(*left.columns, F.lit(1).alias("_side"), F.col(left_time).alias("_at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"))
    facts = right.select(*[(F.col(key) if c == key else F.lit(None).cast(kinds[c]).alias(c)) for c in left.columns], F.lit(0).alias("_side"), F.col(right_time).alias("_at"), F.col(value).alias("_value"))
    along = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.union(facts).withColumn(f"latest_{value}", F.last("_value", ignorenulls=True).over(along)).where("_side = 1").select(*left.columns, f"latest_{value}")
