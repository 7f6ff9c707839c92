"""Helpers that the training-data operators share: table reading, text basics and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.workspace import store

#: Upper-case and lower-case ASCII letters, for the folding that touches nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Elements that a running value is computed over at once; longer arrays go block by block.
BLOCK = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Rows that numbered() ranks in one window.
BUCKET_ROWS = 2_000


def numbered(df: DataFrame, group: list[str], spread: Column, tag: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `slot`, gapless from 0 within each group, without a task that holds a whole group.

    Rows of a group are dealt by a hash of `spread` over as many buckets as its size asks for; a window numbers each
    bucket, and the running sum of the bucket counts gives each its first number. There must be few groups (lengths,
    shards, strata), as their sizes are broadcast. `df` must be stored, as it is read more than once. The order
    within a group is arbitrary but fixed for given rows.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("_buckets"))
    sizes = store(sizes, f"{tag}-sizes").withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
    keyed = df.join(F.broadcast(sizes), [df[g].eqNullSafe(sizes[f"_g{i}"]) for i, g in enumerate(group)])
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.col("_buckets")).cast("int")).select(*df.columns, "_bucket")
    keys = [*group, "_bucket"]
    counts = store(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), f"{tag}-counts")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = store(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), f"{tag}-firsts")
    within = Window.partitionBy(*keys).orderBy(F.xxhash64(spread, F.lit(1)), *[c for c in df.columns if c not in group])
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    named = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = [ranked[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    return ranked.join(named, on).withColumn("slot", F.col("_rank") + F.col("_first")).drop("_bucket", "_rank", "_first", *[f"_k{i}" for i in range(len(keys))])


def bound(body: str, name: str, **values: str) -> str:
    """SQL for `body`, in which the struct `name` holds these values, each computed once: a lambda that names an expression
    again would compute it again for every element."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"get(transform(array(named_struct({fields})), {name} -> {body}), 0)"


def running(values: str, op: str, zero: int, name: str) -> str:
    """SQL for the running `op` ('{a} + {b}', associative, `zero` neutral) over an array of ints, inclusive; block by block,
    so that a long array does not cost its square. `name` begins the names that its lambdas use."""
    n = name
    last = lambda a: f"coalesce(get({a}, size({a}) - 1), {zero})"
    scan = lambda a: f"aggregate({a}, cast(array() AS array<int>), ({n}s, {n}x) -> concat({n}s, array({op.format(a=last(f'{n}s'), b=f'{n}x')})))"
    starts = f"sequence(0, cast(floor((greatest(size({n}v.v), 1) - 1) / {BLOCK}) AS int))"
    blocks = f"transform({starts}, {n}i -> {scan(f'slice({n}v.v, {n}i * {BLOCK} + 1, {BLOCK})')})"
    before = f"concat(array({zero}), slice({n}e.ends, 1, size({n}e.ends) - 1))"
    shifted = f"flatten(zip_with({n}e.blocks, {before}, ({n}k, {n}o) -> transform({n}k, {n}y -> {op.format(a=f'{n}o', b=f'{n}y')})))"
    ends = scan(f"transform({n}b.blocks, {n}t -> {last(f'{n}t')})")
    return bound(bound(bound(shifted, f"{n}e", blocks=f"{n}b.blocks", ends=ends), f"{n}b", blocks=blocks), f"{n}v", v=values)
