"""Durations are BIGINT microseconds; these helpers make and read them."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros_of(gap) -> int:
    """Microseconds of a gap given as text ("30 minutes") or as a timedelta."""
    return int(pd.Timedelta(gap) // pd.Timedelta(1, "us"))


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def duration_us(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def total_seconds(us: Column) -> Column:
    """Whole seconds of a duration, days included."""
    return F.floor(us / F.lit(1_000_000)).cast("bigint")


def seconds_component(us: Column) -> Column:
    """Whole seconds without the whole days, 0..86399."""
    return F.pmod(total_seconds(us), F.lit(86_400))


def parse_timedelta(text: Column) -> Column:
    """Microseconds of a text such as ``1 days 02:03:04.5``; NULL when it is none."""
    pattern = r"^(-?\d+) days?(?: (\d+):(\d+):(\d+)(?:\.(\d+))?)?$"

    def part(i):
        return F.regexp_extract(text, pattern, i)

    def number(i):
        return F.coalesce(F.nullif(part(i), F.lit("")).cast("bigint"), F.lit(0))

    micros = F.rpad(F.substring(part(5), 1, 6), 6, "0").cast("bigint")
    seconds = ((number(1) * 24 + number(2)) * 60 + number(3)) * 60 + number(4)
    return F.when(text.rlike(pattern), seconds * 1_000_000 + micros)
