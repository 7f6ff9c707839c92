"""Whitening of embeddings: the covariance of all dimension pairs in one aggregation of generated SQL, decomposed by LAPACK."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.workspace import store

#: Fixed point: an entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Dimension pairs of one aggregation; vectors with more pairs take one more aggregation for each so many.
PAIRS = 8192


def fixed_points(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """key and `x`, the entries in fixed point, of the rows whose vector is whole: not null, without null or non-finite entries."""
    whole = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return rows.where(whole).select(key, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


@dataclass
class Moments:
    """Count and exact sums of the fit list, and its covariance (divisor n) as a list of rows."""

    n: int
    sums: list[int]
    covariance: list[list[float]]


def moments(points: DataFrame, size: int) -> Moments:
    """Moments of stored fixed points of `size` dimensions. The sums come first, exactly, in one aggregation; then the
    products of centred entries are summed, a SQL expression for each pair of the upper triangle. Partial sums fold before
    the shuffle: a task sends one row, whatever it has read."""
    first = points.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[i]) for i in range(size)]).first()
    n, sums = first[0], [first[i + 1] or 0 for i in range(size)]
    covariance = [[0.0] * size for _ in range(size)]
    if n:
        centred = points.select(*[(F.col("x")[i] - F.lit(sums[i] / n)).alias(f"c{i}") for i in range(size)])
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        for part in range(0, len(pairs), PAIRS):
            chunk = pairs[part : part + PAIRS]
            for (i, j), total in zip(chunk, centred.selectExpr(*[f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in chunk]).first()):
                covariance[i][j] = covariance[j][i] = total / n
    return Moments(n, sums, covariance)


def principal(covariance: list[list[float]], most: int) -> tuple[list[float], list[list[float]], float]:
    """The largest eigenvalues, falling, their unit eigenvectors, and the trace. Directions without variance (an eigenvalue
    that rounding alone can make) are left out, as nothing can be divided by it."""
    import numpy as np

    if not covariance:
        return [], [], 0.0
    matrix = np.asarray(covariance, np.float64)
    values, vectors = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    order = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > 1e-12 * trace]
    return values[order].tolist(), vectors[:, order].T.tolist(), trace


def _dot(weights: list[float], shift: list[float]) -> Column:
    w, m = (F.array(*map(F.lit, x)) for x in (weights, shift))
    centred = F.zip_with("x", m, lambda x, c: x - c)
    return F.aggregate(F.zip_with(centred, w, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)


def whiten(rows: DataFrame, components: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row per vector and component, up to `components`: key, component (from 1, by falling variance), n (vectors fitted),
    deviation (decimal(38,0): the sum over dimensions of (n*x - S) squared, exact), whitened (the centred vector on the
    component, over the root of its variance), explained (its share of all variance), identity_error (the largest
    absolute entry of the whitened rows' covariance minus the identity; one value).

    Vectors that are null, or hold a null or a value that is not finite, are left out of fit and result. Vectors can only be
    fitted together if they have one length: the one most rows have (of equally many, the longer); others, and vectors
    without entries, are left out. Components without variance are left out too: equal vectors, or a single one, give no
    rows. A null key is carried; repeated rows count and come out each; no rows give no rows; other columns are not read.
    The driver holds the covariance and the components, numbers of the dimensions alone.
    """
    points = store(fixed_points(rows, vector, key), "whitening")
    of_size = points.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = of_size.agg(F.max_by("size", F.struct("n", "size"))).first()[0] or 0
    points = points.where(F.size("x") == size)
    m = moments(points, size)
    values, vectors, trace = principal(m.covariance, components)
    mean = [s / m.n for s in m.sums] if m.n else []
    whitened = F.array(*[_dot(v, mean) / F.lit(e**0.5) for e, v in zip(values, vectors)]).cast("array<double>")
    gaps = F.zip_with("x", F.array(*map(F.lit, m.sums)).cast("array<bigint>"), lambda x, s: (F.lit(m.n).cast("decimal(19,0)") * x - s).cast("decimal(19,0)"))
    deviation = F.aggregate(F.transform(gaps, lambda g: (g * g).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g).cast("decimal(38,0)"))
    out = store(points.select(key, deviation.alias("deviation"), whitened.alias("w")), "whitened")
    error = _identity_error(out, m.n, len(values))
    shares = F.array(*[F.lit(e / trace) for e in values]).cast("array<double>")
    long = out.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(key, (F.col("at") + 1).cast("int").alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _identity_error(whitened: DataFrame, n: int, size: int) -> float:
    """Measured on the stored result, centred again."""
    if not n or not size:
        return 0.0
    means = [x / n for x in whitened.agg(*[F.sum(F.col("w")[i]) for i in range(size)]).first()]
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = whitened.agg(*[F.sum(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, sums))
