"""Totals and summaries that reports are made of. All of them are one aggregation, or a few."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(rows: DataFrame, counts: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows in all (`total`) and rows for which each condition holds, in all or by columns."""
    flag = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[flag(c).alias(n) for n, c in counts.items()])


def global_totals(rows: DataFrame, signature: str, source: str) -> DataFrame:
    """total, distinct signatures, signatures of one row, signatures of several sources, rows that repeat another."""
    per = rows.groupBy(signature).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("s"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_distinct"), one(F.col("n") == 1).alias("n_unique"), one(F.col("s") > 1).alias("n_shared"), one(F.col("n") - 1).alias("n_repeated"))


def leaders(rows: DataFrame, name: str, measures: Mapping[str, Column], most: int) -> DataFrame:
    """(list, place, name, value): the first `most` of each measure, ties by name. Each list is a top-k, not a full sort."""
    lists = []
    for title, value in measures.items():
        first = rows.select(F.col(name).cast("string").alias("name"), value.cast("double").alias("value")).orderBy(F.desc("value"), "name").limit(most)
        lists.append(first.agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("o"), "name", "value"))).alias("xs")).select(F.lit(title).alias("list"), F.posexplode("xs").alias("at", "x")).select("list", (F.col("at") + 1).alias("place"), "x.name", "x.value"))
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def recommendations(rows: DataFrame, name: str, issues: Column, weight: Column, most: int) -> DataFrame:
    """Sources with issues, the worst first."""
    return rows.select(name, issues.alias("issues"), weight.alias("weight")).where(F.size("issues") > 0).orderBy("weight", name).limit(most)


def run_health(counters: DataFrame, key: str, raw: str, kept: str, errors: str, least_rate: float) -> DataFrame:
    """Booleans derived from a run's counters: is_empty, is_failing (errors and nothing kept), is_weak (a low share kept), ok."""
    share = F.col(kept) / F.when(F.col(raw) > 0, F.col(raw))
    empty, failing = F.col(raw) == 0, (F.col(errors) > 0) & (F.col(kept) == 0)
    weak = F.coalesce(share < least_rate, F.lit(False)) & ~failing
    return counters.select(key, F.round(share, 4).alias("kept_share"), empty.alias("is_empty"), failing.alias("is_failing"), weak.alias("is_weak"), (~empty & ~failing & ~weak).alias("ok"))


def account_priorities(rows: DataFrame, name: Column, priority: str, verified: str, source: str) -> DataFrame:
    """(name, priority, verified, sources) of normalised names: the highest priority, verified if any row is."""
    named = rows.select(name.alias("name"), priority, verified, source).where("name <> ''")
    return named.groupBy("name").agg(F.max(priority).alias("priority"), F.bool_or(F.coalesce(verified, F.lit(False))).alias("verified"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))


def installs(claims: DataFrame, code: str, completed: str, least: int) -> DataFrame:
    """Per code: completed claims, whether they suffice, and the latest."""
    return claims.groupBy(code).agg(F.count(completed).alias("n_installs"), (F.count(completed) >= least).alias("eligible"), F.max(completed).alias("last_completed"))


def accumulated(stats: DataFrame, run: DataFrame, key: str, counters: Sequence[str], last: str) -> DataFrame:
    """Counters of all runs so far: old sums and this run's, and the latest moment."""
    return stats.unionByName(run).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters], F.max(last).alias(last))


def bucketed_report(rows: DataFrame, row_id: str, text: Column, buckets: Sequence[tuple[str, str]], order: Column, most: int) -> DataFrame:
    """(bucket, ids, n): the first bucket whose pattern the text holds; of each, its size and the first `most` ids in order."""
    label = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in buckets])
    marked = rows.select(label.alias("bucket"), row_id, order.alias("_o")).where("bucket is not null")
    from plumbline.operators.reviews import latest_per_group

    sizes = marked.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    first = latest_per_group(marked, "bucket", [F.col("_o"), F.col(row_id)], most)
    ids = first.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", row_id))), lambda r: r[row_id].cast("string")), ",").alias("ids"))
    return ids.join(sizes, F.col("bucket") == F.col("_b")).select("bucket", "ids", "n")
