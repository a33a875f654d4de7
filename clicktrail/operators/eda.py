"""Exploratory tables: frequencies, histograms, densities, correlations."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.functions.calendar import day_floor
from clicktrail.spark import materialize

# Length of the top lists, end of the count histograms, points of a density curve.
TOP = 40
HISTOGRAM_LIMIT = 16
GRID_POINTS = 200
#: Cells of a density's range.
BINS = 1 << 16
MOMENTS = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]


def freq(df: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def top_values(df: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """The n most frequent values; ties go to the smaller value."""
    return freq(df, column).limit(n)


def count_histogram(sessions: DataFrame, column: str, limit: int = HISTOGRAM_LIMIT) -> DataFrame:
    """Sessions per value of a count column, below the limit."""
    return sessions.filter(F.col(column) < limit).groupBy(column).count()


def daily_counts(sessions: DataFrame, purchases_only: bool = False) -> DataFrame:
    """Sessions per calendar day of their first event."""
    if purchases_only:
        sessions = sessions.filter(F.col(S.LABEL) == 1)
    return sessions.groupBy(day_floor(F.col(S.TIME)).alias("day")).count()


def hour_type_histogram(events: DataFrame, types=("purchase", "cart", "view")) -> DataFrame:
    return events.filter(F.col(S.TYPE).isin(list(types))).groupBy("hour", S.TYPE).count()


def kde_cells(df: DataFrame, column: str, low: float, high: float, bins: int = BINS) -> DataFrame:
    """Values by cell of a grid: ``(k, cell, n, mean, square)``, the number, mean and squared deviations of its values.

    A cell is ``2 ** k`` steps of ``(high - low) / bins`` wide.  k is 0 up to one range away from the middle and grows by one whenever that
    distance doubles, so there are at most some ``bins`` cells per octave, whatever the values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    step, middle = (high - low) / bins, (low + high) / 2
    octave = F.floor(F.log2(F.abs(F.col("v") - middle) / (high - low)))
    placed = values.withColumn("k", F.greatest(F.coalesce(octave, F.lit(0)), F.lit(0)).cast("int"))
    placed = placed.withColumn("cell", F.floor((F.col("v") - low) / (F.lit(step) * F.pow(F.lit(2.0), F.col("k")))))
    return placed.groupBy("k", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count(F.lit(1))).alias("square"))


def kde(df: DataFrame, column: str, low: float, high: float, points: int = GRID_POINTS, bins: int = BINS) -> DataFrame:
    """Gaussian density with Scott's bandwidth h on an even grid: ``(x, density)``.

    One pass counts values by cell (``kde_cells``); number and deviation of all values follow from the cells exactly.  The values of a cell then
    stand as weights on its two ends (linear binning), and only ends meet the grid points.  That changes the
    density by at most ``(w / h) ** 2 / 8`` of the kernel's peak, w being the width of the cells around: ``(high - low) / bins`` inside the range.
    A constant column has no density: NULL at every point.
    """
    cells = materialize(kde_cells(df, column, low, high, bins), "density-cells")
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s")).first()
    n = total["n"] or 0
    if not n:
        return cells.select(F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("density")).limit(0)
    around = F.col("mean") - F.lit(total["s"] / n)
    squares = cells.agg(F.sum(F.col("square") + F.col("n") * around * around)).first()[0]
    h = math.sqrt(squares / (n - 1)) * n ** -0.2 if n > 1 else 0.0
    grid_step, step = (high - low) / (points - 1), (high - low) / bins
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(float(low)) + i * F.lit(grid_step))
    if not h:
        return cells.limit(1).select(F.explode(grid).alias("x"), F.lit(None).cast("double").alias("density"))
    width = F.lit(step) * F.pow(F.lit(2.0), F.col("k"))
    ends = cells.withColumn("w", width).withColumn("a", F.lit(float(low)) + F.col("cell") * F.col("w"))
    right = F.col("n") * (F.col("mean") - F.col("a")) / F.col("w")
    ends = ends.select("a", (F.col("a") + F.col("w")).alias("b"), (F.col("n") - right).alias("left"), right.alias("right"))
    kernel = lambda at: F.exp(F.lit(-0.5) * F.pow((F.col("x") - at) / F.lit(h), 2))
    terms = ends.withColumn("x", F.explode(grid)).groupBy("x").agg(
        F.sum(F.col("left") * kernel(F.col("a")) + F.col("right") * kernel(F.col("b"))).alias("total"))
    return terms.select("x", (F.col("total") / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


def co_moments(df: DataFrame, columns) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)`` for i <= j: sums over the rows in which both columns are present.

    One pass: each task adds up matrix products of its batches and sends the triangle once.  Sums are of differences to
    a first value, the mean of a few leading rows, which keeps them small against the deviations.
    """
    numbers = df.select([F.col(f"`{c.replace('`', '``')}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    lead = numbers.limit(100).toPandas().to_numpy(dtype=float)
    present = np.isfinite(lead)
    first = np.where(present, lead, 0).sum(0) / np.maximum(present.sum(0), 1) if len(lead) else np.zeros(len(columns))

    def run(batches):
        size = len(first)
        sums = np.zeros((4, size, size))
        for batch in batches:
            data = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            there = np.stack([np.asarray(c.is_valid()) for c in batch.columns], 1).astype(float)
            z = np.where(there > 0, data - first, 0.0)
            sums += np.stack([there.T @ there, z.T @ there, (z * z).T @ there, z.T @ z])
        i, j = np.triu_indices(size)
        n, x, xx, xy = sums
        ends = [pa.array(a.astype(np.int32)) for a in (i, j)]
        yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, (n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]))], MOMENTS)

    kinds = ", ".join(f"{m} {'int' if m in 'ij' else 'double'}" for m in MOMENTS)
    partial = numbers.mapInArrow(run, kinds)
    return partial.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS[2:]])


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of every pair of columns: ``(a, b, r)``, both orders and the diagonal.

    One pass over the rows (``co_moments``), for hundreds of columns of any name.  A pair uses the rows where both columns are present; a
    constant column has NULL correlations.
    """
    columns = list(columns)
    about = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    # what rounding leaves of a constant column is no deviation
    spread = lambda s, ss: F.when(about(s, ss) > 1e-12 * F.col(ss), about(s, ss))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    ends = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    both = co_moments(df, columns).filter("n > 0").select(F.explode(F.array_distinct(ends)).alias("e"), r.alias("r"))
    every = df.sparkSession.range(len(columns) ** 2).select(
        F.expr(f"CAST(id DIV {len(columns)} AS INT)").alias("_a"), F.expr(f"CAST(id % {len(columns)} AS INT)").alias("_b"))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in columns]), F.col(c) + 1)
    found = every.join(both.select("e.a", "e.b", "r"), (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left")
    return found.select(name("_a").alias("a"), name("_b").alias("b"), "r")
