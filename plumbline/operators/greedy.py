"""Greedy merges over several keys in the order of rows, as one pass with a map from keys to records would make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import components
from plumbline.operators.joins import join_unique
from plumbline.workspace import store

#: Ranges of row numbers that the history of a contested record is cut into.
RANGES = 64
#: Rows of a group that one task passes over at most; larger groups go by rounds.
AT_ONCE = 50_000


def greedy_records(rows: DataFrame, row_no: str, keys: Column, most_rounds: int = 200, at_once: int = AT_ONCE) -> DataFrame:
    """(row_no, record): the record that each row joins, named by its first row, if rows come by `row_no`, a unique number.

    A row joins the record that the first of its keys that is known stands for, else it begins one. The record takes the
    row's keys up, and all keys of the record stand for it from then on, also those that stood for another before: so what a
    key stands for depends on who came last, and the result on the order of rows. `keys` is an array of strings in order of
    precedence; null and empty ones do not count, and a row without keys is a record of its own.

    Rows that no chain of shared keys connects do not meet, so each group of connected rows (`components`) is merged by itself:
    one of at most `at_once` rows by the pass, in whatever task it falls, with no more in memory than its keys; larger ones by
    rounds, in which no task holds a group. While one record only holds a key, the key stands for it from its first row
    on, so a row follows that first row, and records are the trees of a forest (`components`). Keys that several records hold
    are contested: there, from the records of the last round, the one that was last joined before the row counts. What a row
    does follows from the rows before it alone, so a round that changes nothing has the records of the pass; each round
    settles one more turn of a contested key at least. Raises after `most_rounds`.
    """
    base = store(rows.select(F.col(row_no).alias("r"), keys.alias("keys")), "greedy-rows")
    held = base.select("r", F.posexplode("keys").alias("p", "key")).where("key is not null and key <> ''").groupBy("r", "key").agg(F.min("p").alias("p"))
    held = store(held, "greedy-keys")
    firsts = store(held.groupBy("key").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")), "greedy-firsts")
    known = store(join_unique(held, firsts.select("key", "first"), ["key"], firsts), "greedy-known")
    groups = components(known.where("first < r").select(F.col("r").alias("a"), F.col("first").alias("b")))
    groups = store(base.join(groups, F.col("r") == F.col("id"), "left").select("r", "keys", F.coalesce("component", "r").alias("group")), "greedy-groups")
    large = store(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).select(F.col("group").alias("_group")), "greedy-large")
    of_large = lambda how: groups.join(large, F.col("group") == F.col("_group"), how)
    small = _by_pass(of_large("left_anti"))
    if not large.isEmpty():
        rest = store(of_large("left_semi").select("r"), "greedy-rest")
        known = store(known.join(rest.withColumnRenamed("r", "_r"), F.col("r") == F.col("_r"), "left_semi"), "greedy-known")
        small = small.unionByName(_by_rounds(rest, known, most_rounds))
    return small.select(F.col("r").alias(row_no), "record")


def _by_pass(grouped: DataFrame) -> DataFrame:
    """(r, record) of rows (r, keys, group), each group in one task. Of the records that hold a key, the one joined last has it."""

    def one_pass(parts):
        import pandas as pd

        group, holders, last = None, {}, {}
        for part in parts:
            records = []
            for r, g, keys in zip(part["r"].tolist(), part["group"].tolist(), part["keys"].tolist()):
                if g != group:
                    group, holders, last = g, {}, {}
                keys = [k for k in keys if k] if keys is not None else []
                known = next((holders[k] for k in keys if k in holders), None)
                record = max(known, key=last.__getitem__) if known else r
                for k in keys:
                    holders.setdefault(k, set()).add(record)
                last[record] = r
                records.append(record)
            yield pd.DataFrame({"r": part["r"], "record": records})

    kind = dict(grouped.dtypes)["r"]
    return grouped.repartition("group").sortWithinPartitions("group", "r").mapInPandas(one_pass, f"r {kind}, record {kind}")


def _by_rounds(base: DataFrame, known: DataFrame, most_rounds: int) -> DataFrame:
    """(r, record) by rounds over the rows `base` (r) and their keys `known` (r, p, key, first)."""
    before, follows = None, known.where("first < r").select("r", "p", F.col("first").alias("at"))
    for _ in range(most_rounds):
        least = follows.groupBy("r").agg(F.min_by("at", "p").alias("b")).select(F.col("r").alias("a"), "b")
        roots = components(least).withColumnRenamed("id", "_id")
        record = store(base.select("r").join(roots, F.col("r") == F.col("_id"), "left").select("r", F.coalesce("component", "r").alias("record")), "greedy-records")
        if before is not None and record.join(before.withColumnsRenamed({"r": "_r", "record": "_record"}), F.col("r") == F.col("_r")).where("record <> _record").isEmpty():
            break
        before = record
        ours = store(known.join(record.withColumnRenamed("r", "_r"), F.col("r") == F.col("_r")).select("r", "p", "key", "first", "record"), "greedy-ours")
        since = store(ours.groupBy("key", "record").agg(F.min("r").alias("since")), "greedy-since")
        contested = store(since.groupBy("key").agg(F.count(F.lit(1)).alias("records")).where("records > 1").select(F.col("key").alias("_key")), "greedy-contested")
        if contested.isEmpty():
            break
        calm = ours.join(contested, F.col("key") == F.col("_key"), "left_anti").where("first < r").select("r", "p", F.col("first").alias("at"))
        claims = since.join(contested, F.col("key") == F.col("_key")).select(F.col("key").alias("_key"), F.col("record").alias("rival"), "since")
        asked = ours.join(claims, F.col("key") == F.col("_key")).where("since < r").select("r", "p", "rival")
        winners = _last_joined(store(asked, "greedy-asked"), record).groupBy("r", "p").agg(F.max_by("rival", "last").alias("at"))
        follows = store(calm.unionByName(winners), "greedy-follows")
    else:
        raise RuntimeError(f"records did not settle in {most_rounds} rounds")
    return record


def _last_joined(asked: DataFrame, record: DataFrame) -> DataFrame:
    """(r, p, rival, last): the last row before r that joined the record `rival`. Rows of a record are cut into ranges of row
    numbers, so that no task holds them all, and each range starts from the last row of those before it."""
    rivals = asked.select(F.col("rival").alias("_rival")).distinct()
    joined = record.join(rivals, F.col("record") == F.col("_rival"), "left_semi").select(F.col("record").alias("rival"), "r")
    low, high = record.agg(F.min("r"), F.max("r")).first()
    in_range = F.floor((F.col("r") - F.lit(low)) * F.lit(RANGES) / F.lit(high - low + 1)).cast("int")
    both = joined.select("rival", "r", F.lit(None).cast("int").alias("p")).unionByName(asked.select("rival", "r", "p")).withColumn("part", in_range)
    ends = both.where("p is null").groupBy("rival", "part").agg(F.max("r").alias("end"))
    # a record has at most RANGES of these
    every = both.select("rival", "part").distinct().join(ends, ["rival", "part"], "left")
    earlier = Window.partitionBy("rival").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(every.select("rival", "part", F.max("end").over(earlier).alias("start")), "greedy-starts")
    within = Window.partitionBy("rival", "part").orderBy("r").rangeBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("own", F.max(F.when(F.col("p").isNull(), F.col("r"))).over(within)).where("p is not null")
    return last.join(starts, ["rival", "part"]).select("r", "p", "rival", F.coalesce("own", "start").alias("last"))


def greedy_merge(rows: DataFrame, row_no: str, keys: Column, better: Column, columns: list[str], fill: list[str] = ()) -> DataFrame:
    """One row a record of greedy_records: `record`, the `columns` of its best row (highest `better`; the earlier on a tie),
    n_merged, and `fill` columns, each the first value that is not null, best row first."""
    ranked = F.struct(better, -F.col(row_no))
    found = greedy_records(rows, row_no, keys).withColumnRenamed(row_no, "_r")
    merged = rows.join(found, F.col(row_no) == F.col("_r")).groupBy("record").agg(
        F.max_by(F.struct(*columns), ranked).alias("_best"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), ranked)).alias(c) for c in fill],
        F.count(F.lit(1)).alias("n_merged"),
    )
    return merged.select("record", *[F.col(f"_best.{c}").alias(c) for c in columns], *fill, "n_merged")
