"""Feature selection, encoding and scaling.

What is fitted is a handful of numbers or level names, read from one
aggregate; applying it is an expression without a join.
"""

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.operators.eda import correlation_matrix

#: More levels of a column than this are an error: each becomes a column.
MAX_LEVELS = 1000


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"

# Fixed value: pairs correlated above it lose their later column.
CORRELATION_CUT = 0.9


def correlated_features(df: DataFrame, columns, threshold: float = CORRELATION_CUT) -> DataFrame:
    """Columns correlated with an earlier one: ``(position, feature)``.

    The earlier column counts even when it is itself to be dropped.
    """
    position = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    pairs = correlation_matrix(df, columns).withColumns({"position": position[F.col("a")], "_other": position[F.col("b")]})
    late = pairs.filter((F.abs("r") > threshold) & (F.col("position") > F.col("_other")))
    return late.select("position", F.col("a").alias("feature")).distinct()


def drop_correlated(train: DataFrame, others, columns, threshold: float = CORRELATION_CUT):
    """Fit on train, drop from train and all others; returns the kept names too."""
    late = {r["feature"] for r in correlated_features(train, columns, threshold).collect()}  # at most one row per column
    kept = [c for c in columns if c not in late]
    return [df.drop(*late) for df in (train, *others)], kept


@dataclass(frozen=True)
class OneHot:
    """Indicator columns ``column_level`` for fitted levels, alphabetical."""

    levels: dict
    keep: bool = False

    @property
    def names(self) -> list:
        return [f"{c}_{v}" for c, values in self.levels.items() for v in values]

    def apply(self, df: DataFrame) -> DataFrame:
        columns = {
            f"{c}_{v}": F.coalesce(F.col(quoted(c)).cast("string") == v, F.lit(False)).cast("int")
            for c, values in self.levels.items()
            for v in values
        }
        out = df.withColumns(columns) if columns else df
        return out if self.keep else out.drop(*self.levels)


def one_hot(df: DataFrame, columns, drop_first: bool = False, keep: bool = False) -> OneHot:
    """Fit levels on one table (train) and use them on any other; more than ``MAX_LEVELS`` of a column raise."""
    levels = {}
    for c in columns:
        # as many rows reach the driver as are allowed, and one more to tell
        level = F.col(quoted(c))
        found = [r[0] for r in df.select(level.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        levels[c] = [str(v) for v in found][int(drop_first):]
    return OneHot(levels, keep)


@dataclass(frozen=True)
class Scaler:
    """``(x - shift) / scale`` per column; results are not clipped."""

    parameters: dict

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(quoted(c)).cast("double") - F.lit(shift)) / F.lit(scale) for c, (shift, scale) in self.parameters.items()}
        )


def _scaler(df: DataFrame, columns, shift, scale) -> Scaler:
    number = {c: F.col(quoted(c)).cast("double") for c in columns}
    row = df.agg(*[x for c in columns for x in (shift(number[c]).alias(f"{c}_0"), scale(number[c]).alias(f"{c}_1"))]).first()
    return Scaler({c: (row[f"{c}_0"], row[f"{c}_1"] or 1.0) for c in columns})


def standard_scale(df: DataFrame, columns) -> Scaler:
    """Zero mean and unit population deviation; a constant column is only shifted."""
    return _scaler(df, columns, F.avg, F.stddev_pop)


def min_max(df: DataFrame, columns) -> Scaler:
    """Range 0..1 on the fitted table; a constant column is only shifted."""
    return _scaler(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def assemble(df: DataFrame, columns, name: str = "features") -> DataFrame:
    # plain names for the assembler, which does not read quoted ones
    plain = [f"__{i}" for i in range(len(columns))]
    numbers = df.withColumns({p: F.col(quoted(c)).cast("double") for p, c in zip(plain, columns)})
    out = VectorAssembler(inputCols=plain, outputCol=name).transform(numbers).drop(*plain)
    return out.withColumns({c: F.col(quoted(c)).cast("double") for c in columns})
