"""A budget of checks, allotted over strata by what the next check in each is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rank import positions
from plumbline.workspace import store

#: Scores are whole numbers from 1 to this; higher ones count as this much.
MOST_SCORE = 10_000


def allotted(rows: DataFrame, stratum: str, score: str, key: str, budget: int, step: int) -> DataFrame:
    """The rows that a budget of checks goes to, with `worth`, as if one check after another went to the stratum whose next row is
    worth most.

    A row is worth its score less `step` for each row of its stratum that is checked before it: within a stratum rows go by
    falling score, then by `key`, which must be unique; between strata that offer the same the smaller name comes first. A row
    that is worth nothing is not checked, however much of the budget is left, nor is one with a null or non-positive score. A
    null stratum is one like the others, before all names.

    Rows are aggregated once, to the histogram of scores in each stratum. From it follows how many rows of each worth there
    are: at most MOST_SCORE numbers, which the driver reads to find the level at which the budget is spent. A stratum gives
    whole scores down to the one at the edge of its share; rows of these scores are numbered, over ranges, so that no task holds a
    stratum.
    """
    if step < 1:
        raise ValueError("step must be 1 or more")
    scored = rows.withColumn("_v", F.when(F.col(score) >= 1, F.least(F.floor(score).cast("long"), F.lit(MOST_SCORE)))).where("_v > 0")
    held = scored.groupBy(F.col(stratum).alias("_s"), "_v").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("_s").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    # ranks from _before to _last within the stratum have this score and are worth something
    ranked = held.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    cells = store(ranked.withColumn("_last", F.least(F.expr("_before + _n"), F.expr(f"(_v + {step} - 1) div {step}")) - 1).where("_last >= _before"), "budget-cells")
    worths = cells.select(F.explode(F.transform(F.sequence("_before", "_last"), lambda rank: F.col("_v") - rank * step)).alias("worth")).groupBy("worth").agg(F.count(F.lit(1)).alias("n"))
    level, left = 0, budget
    for r in sorted(worths.collect(), reverse=True):
        level = r["worth"]
        if r["n"] > left:
            break
        left -= r["n"]
    else:
        level, left = 0, 0
    # strata that offer a row at the level itself: one each, and the first `left` of them get it
    at_level = (F.col("_v") - F.lit(level)) % step == 0
    rank_at = ((F.col("_v") - level) / step).cast("long")
    offers = cells.where(at_level & rank_at.between(F.col("_before"), F.col("_last"))).select("_s", F.lit(1).alias("_more"))
    more = offers.orderBy(F.asc_nulls_first("_s")).limit(left).withColumnRenamed("_s", "_t")
    over = F.greatest(F.least(F.col("_last"), F.floor((F.col("_v") - level - 1) / step)) - F.col("_before") + 1, F.lit(0))
    taken = cells.groupBy("_s").agg(F.sum(over).alias("_over")).join(more, F.col("_s").eqNullSafe(F.col("_t")), "left")
    shares = taken.select(F.col("_s").alias("_stratum"), (F.col("_over") + F.coalesce("_more", F.lit(0))).alias("_share")).where("_share > 0")
    edges = store(cells.join(shares, F.col("_s").eqNullSafe(F.col("_stratum"))).where("_before < _share").select("_stratum", F.col("_v").alias("_score"), "_before", "_share"), "budget-edges")
    on = F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_v") == F.col("_score"))
    given = scored.join(edges, on)
    places = positions(given.select(*rows.columns, "_v", "_before", "_share"), [stratum, "_v"], [(key, True)], "budget-places").where("position < _share - _before")
    return places.select(*rows.columns, (F.col("_v") - (F.col("_before") + F.col("position")) * step).alias("worth"))
