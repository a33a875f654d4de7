"""Row filters, projections, membership joins and set operations."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail import schemas as S
from clicktrail.functions.text import UNKNOWN_BRAND, UNKNOWN_CATEGORY


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def only(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def drop_event_types(df: DataFrame, types) -> DataFrame:
    return df.filter(~F.col(S.TYPE).isin(list(types)))


def below(df: DataFrame, column: str, limit) -> DataFrame:
    return df.filter(F.col(column) < F.lit(limit))


sessions_below = below


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict) -> DataFrame:
    return df.withColumnsRenamed(names)


def columns_by_type(df: DataFrame, kind: str) -> list:
    """Names of the ``numeric`` (without booleans), ``boolean``, ``text`` or ``time`` columns."""
    wanted = {
        "numeric": T.NumericType,
        "boolean": T.BooleanType,
        "text": T.StringType,
        "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
    }[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.select(columns_by_type(df, kind))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column that has any: ``(column, nulls)``, one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls").filter("nulls > 0")


def fill_unknown(df: DataFrame) -> DataFrame:
    fills = {"brand": UNKNOWN_BRAND, "category_code": UNKNOWN_CATEGORY}
    fills.update({c: UNKNOWN_CATEGORY for c in S.CATEGORY_LEVELS})
    return df.fillna({c: v for c, v in fills.items() if c in df.columns})


def semi(df: DataFrame, keys: DataFrame, on=None) -> DataFrame:
    """Rows whose key occurs in ``keys`` (by default the session key)."""
    on = on or S.SESSION_KEY
    return df.join(keys.select(on), on, "left_semi").select(df.columns)


def anti(df: DataFrame, keys: DataFrame, on=None) -> DataFrame:
    on = on or S.SESSION_KEY
    return df.join(keys.select(on), on, "left_anti").select(df.columns)


def append(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def distinct_items(items: Column) -> Column:
    return F.array_distinct(items)


def ordered(df: DataFrame, *keys) -> DataFrame:
    """Total order; add the event id as last key where times may tie."""
    return df.orderBy(*keys)


def shuffle_rows(df: DataFrame, key, seed) -> DataFrame:
    """Rows in a pseudo-random order that depends on seed and key only."""
    from clicktrail.functions.text import seeded_digest

    key = [key] if isinstance(key, str) else key
    return df.orderBy(seeded_digest(seed, *map(F.col, key)), *key)


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in the given order.

    An aggregate, not a ranking window: a hot key is reduced on the map side.
    """
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")
