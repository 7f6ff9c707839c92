"""Reviews, evidence, overrides and commands meet the rows they speak of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import renamed


def without_rejected(rows: DataFrame, judged: DataFrame, key: str, rejected: Column) -> DataFrame:
    """Rows whose key no judged row rejects; rows without a key stay."""
    vetoed = judged.where(rejected & F.col(key).isNotNull()).select(F.col(key).alias("_vetoed")).distinct()
    return rows.join(vetoed, F.col(key) == F.col("_vetoed"), "left_anti")


def supplemented(rows: DataFrame, index: DataFrame, key: str, order: Column, columns: Sequence[str], weak: Column) -> DataFrame:
    """The best index row of a key (highest `order`) fills columns that are null or empty, and replaces those of `weak` rows.

    `filled` lists the columns that changed. `weak` is a condition on the rows; the index folds before the join.
    """
    best = renamed(index.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns]), "_i_")
    joined = rows.withColumn("_weak", F.coalesce(weak, F.lit(False))).join(best, F.col(key) == F.col(f"_i_{key}"), "left")
    lacking = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    take = lambda c: F.col(f"_i_{c}").isNotNull() & (lacking(c) | F.col("_weak")) & ~F.col(f"_i_{c}").eqNullSafe(F.col(c))
    filled = F.array_join(F.array_compact(F.array(*[F.when(take(c), F.lit(c)) for c in columns])), ",")
    return joined.select(*[F.when(take(c), F.col(f"_i_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], filled.alias("filled"))


def coverage(places: DataFrame, ids: str, group: str, live: DataFrame, live_id: str, required: DataFrame, need: str) -> DataFrame:
    """Per required group: places, references, references to nothing, and whether it has the places that it needs.

    `places` lists ids per row; `required` has `group` and `need`. A group without places has none.
    """
    refs = places.select(F.col(group).alias("_g"), F.explode(ids).alias("_id"))
    known = live.select(F.col(live_id).alias("_live")).distinct()
    counted = refs.join(known, F.col("_id") == F.col("_live"), "left").groupBy("_g").agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.col("_live").isNull().cast("long")).alias("n_dangling"))
    sizes = places.groupBy(F.col(group).alias("_s")).agg(F.count(F.lit(1)).alias("n_places"))
    joined = required.join(sizes, F.col(group) == F.col("_s"), "left").join(counted, F.col(group) == F.col("_g"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(group, need, zero("n_places"), zero("n_refs"), zero("n_dangling"), (F.coalesce("n_places", F.lit(0)) >= F.col(need)).alias("covered"))


def publication(published: Column, trusted: Column, decoded: Column) -> Column:
    """(moment, source): the stated publication where it is trusted, else the moment that the id encodes, else none."""
    stated = F.when(F.coalesce(trusted, F.lit(False)) & published.isNotNull(), F.struct(published.alias("moment"), F.lit("stated").alias("source")))
    return F.coalesce(stated, F.when(decoded.isNotNull(), F.struct(decoded.alias("moment"), F.lit("decoded").alias("source"))))


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, at: str, columns: Sequence[str], protected: Column, least: float, removable: Sequence[str]) -> DataFrame:
    """The latest review of each row, held against fixed policy, and its patch of `columns`.

    `reviews` has key, `at`, decision (keep, remove, patch), reason, confidence and a column for each of `columns` (null: no
    change). A removal holds for rows that are not `protected`, with a confidence of `least` and a reason among
    `removable`; others are `held`. A patch changes only the columns named, of rows that stay.
    """
    row = F.struct("decision", "reason", "confidence", *columns)
    latest = reviews.groupBy(key).agg(F.max_by(row, F.struct(at, "confidence", "decision")).alias("_r")).withColumnRenamed(key, "_key")
    joined = rows.withColumn("_safe", F.coalesce(protected, F.lit(False))).join(latest, F.col(key) == F.col("_key"), "left")
    asked = F.col("_r.decision") == "remove"
    sure = (F.col("_r.confidence") >= least) & F.col("_r.reason").isin(*removable) & ~F.col("_safe")
    outcome = F.when(F.col("_key").isNull(), "unreviewed").when(asked & sure, "removed").when(asked, "held").when(F.col("_r.decision") == "patch", "patched").otherwise("kept")
    patch = lambda c: F.when(outcome == "patched", F.coalesce(F.col(f"_r.{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[patch(c) if c in columns else F.col(c) for c in rows.columns], outcome.alias("outcome"))


def overridden(rows: DataFrame, picks: DataFrame, key: str, url: str, columns: Sequence[str]) -> DataFrame:
    """Picks override columns of the row with their id, or else with their URL: two equi-joins, the id's match first."""
    by_id = renamed(picks.select(key, *columns), "_i_")
    by_url = renamed(picks.where(F.col(url).isNotNull()).groupBy(url).agg(*[F.max_by(c, key).alias(c) for c in columns]), "_u_")
    joined = rows.join(by_id, F.col(key) == F.col(f"_i_{key}"), "left").join(by_url, F.col(url) == F.col(f"_u_{url}"), "left")
    matched = F.when(F.col(f"_i_{key}").isNotNull(), "id").when(F.col(f"_u_{url}").isNotNull(), "url").otherwise("")
    value = lambda c: F.when(matched == "id", F.coalesce(f"_i_{c}", c)).when(matched == "url", F.coalesce(f"_u_{c}", c)).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(c) for c in rows.columns], matched.alias("matched"))


def review_queue(rows: DataFrame, candidates: DataFrame, key: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows for review: those that candidates name come first, each part in the given order."""
    named = candidates.select(F.col(key).alias("_c")).distinct()
    joined = rows.join(named, F.col(key) == F.col("_c"), "left").withColumn("named", F.col("_c").isNotNull()).drop("_c")
    return joined.orderBy(F.desc("named"), *order).limit(most)


def owners_to_verify(rows: DataFrame, owner: str, at: str, resting: DataFrame, fixed: int, turn: int, most: int) -> DataFrame:
    """Owners by open rows, then newest, without those in `resting`: the first `fixed`, and a window of the others that moves
    on by `most` a turn. (owner, n_rows, newest, is_fixed). The window is found from a count, not by ranking the owners."""
    counted = rows.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.count(F.lit(1)).alias("n_rows"), F.max(at).alias("newest"))
    awake = counted.join(resting.select(F.col(owner).alias("_r")).distinct(), F.col(owner) == F.col("_r"), "left_anti")
    order = [F.desc("n_rows"), F.desc("newest"), F.col(owner)]
    first = awake.orderBy(*order).limit(fixed)
    others = awake.join(first.select(F.col(owner).alias("_f")), F.col(owner) == F.col("_f"), "left_anti")
    spread = others.withColumn("_turn", F.pmod(F.xxhash64(owner), F.lit(1 << 20)))
    begin = (turn * most * 7919) % (1 << 20)
    window = spread.orderBy(F.pmod(F.col("_turn") - begin, F.lit(1 << 20)), owner).limit(most).drop("_turn")
    return first.withColumn("is_fixed", F.lit(True)).unionByName(window.withColumn("is_fixed", F.lit(False)))


def commands(messages: DataFrame, message_id: str, text: str, fields: Sequence[str]) -> DataFrame:
    """`edit <id> <field>=<value>; ...` in messages, one row a command: (message, target, field, value); other fields are passed over."""
    said = messages.select(F.col(message_id).alias("message"), F.regexp_extract(text, r"(?is)^\s*edit\s+(\S+)\s+(.+)$", 1).alias("target"), F.regexp_extract(text, r"(?is)^\s*edit\s+(\S+)\s+(.+)$", 2).alias("said"))
    each = said.where("target <> ''").select("message", "target", F.explode(F.split("said", ";")).alias("part"))
    parts = each.select("message", "target", F.lower(F.trim(F.regexp_extract("part", r"^([^=]+)=", 1))).alias("field"), F.trim(F.regexp_extract("part", r"(?s)^[^=]+=(.*)$", 1)).alias("value"))
    return parts.where(F.col("field").isin(*fields))


def commanded(rows: DataFrame, key: str, told: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Commands applied to the rows they target: of several for a field, the last message's."""
    last = told.groupBy("target", "field").agg(F.max_by("value", F.struct("message", "value")).alias("value"))
    wide = last.groupBy("target").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_t_{f}") for f in fields])
    joined = rows.join(wide, F.col(key).cast("string") == F.col("target"), "left")
    return joined.select(*[F.coalesce(f"_t_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def existing(submissions: DataFrame, queue: DataFrame, url: str, open_states: Column, rank: str, most: int = 999) -> DataFrame:
    """Submissions whose URL is already in the queue in an open state, with the rank within 0 to `most`."""
    waiting = queue.where(open_states).select(F.col(url).alias("_q")).distinct()
    held = submissions.join(waiting, F.col(url) == F.col("_q"), "left_semi")
    return held.withColumn(rank, F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(rank, F.lit(0)))))


def with_new_entries(entries: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries, and of the new ones those whose key is not there; once each."""
    fresh = new.dropDuplicates(list(keys)).join(renamed(entries.select(*keys).distinct(), "_e_"), [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], "left_anti")
    return entries.unionByName(fresh.select(*entries.columns))


def acknowledged(rows: DataFrame, posted: DataFrame, key: str) -> DataFrame:
    """Adds `posted`: whether the row's id is among those posted."""
    seen = posted.select(F.col(key).alias("_p")).distinct()
    return rows.join(seen, F.col(key) == F.col("_p"), "left").withColumn("posted", F.col("_p").isNotNull()).drop("_p")


def merged_reviews(marks: DataFrame, key: str, reason: str, at: str, sign: str = " + ") -> DataFrame:
    """(key, reasons, n_marks, first_at): distinct reasons of a row in the order in which they first came. Reasons of a key
    fold before the shuffle, so that a key that is marked often costs one row a reason."""
    firsts = marks.groupBy(key, reason).agg(F.min(at).alias("_at"), F.count(F.lit(1)).alias("_n"))
    rows = F.array_sort(F.collect_list(F.struct("_at", F.col(reason).alias("_reason"))))
    return firsts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["_reason"]), sign).alias("reasons"), F.sum("_n").alias("n_marks"), F.min("_at").alias("first_at"))


def removals(first: DataFrame, second: DataFrame, key: str, order: Sequence[Column], most: int) -> DataFrame:
    """Removed rows of two reports, one a key (the first report's), the first `most` in order."""
    both = first.withColumn("report", F.lit(1)).unionByName(second.withColumn("report", F.lit(2)))
    names = [c for c in both.columns if c != key]
    folded = both.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("report", *[c for c in names if c != "report"])).alias("_row")).select(key, "_row.*")
    return folded.orderBy(*order).limit(most)


def rejects(rows: DataFrame, gates: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds `reject`: the first gate that holds, null for rows that pass all."""
    return rows.withColumn("reject", F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in gates]))


def latest_per_group(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)
