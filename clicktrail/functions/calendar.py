"""Calendar features of an event time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the six four-hour parts of a day, from midnight on.
DAY_TIMES = ["Late Night", "Early Morning", "Morning", "Noon", "Evening", "Night"]
# English calendar names.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Last day of month of each week band; the second band has eight days.
WEEK_BANDS = [7, 15, 22, 31]


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parse_event_time(text: Column) -> Column:
    """Time without zone from ``2020-01-31 10:11:12 UTC`` or a plain time text.

    A zone after a space is converted, in a session whose time zone is UTC; an offset that
    is part of the time, as in ``10:11:12+05:00``, is dropped and the clock time stays.
    Unreadable text gives NULL.
    """
    zoned = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS] z")).cast("timestamp_ntz")
    return F.coalesce(text.try_cast("timestamp_ntz"), zoned)


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def is_weekday(ts: Column) -> Column:
    return weekday(ts) < 5


def day_time(ts: Column) -> Column:
    return F.element_at(_texts(DAY_TIMES), (F.floor(F.hour(ts) / 4) + 1).cast("int"))


def day_floor(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def calendar_parts(ts: Column) -> dict:
    """All calendar columns of an event, by name."""
    return {
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "weekDay": weekday(ts),
        "hour": F.hour(ts),
        "weekDayOrNot": is_weekday(ts),
        "dayTime": day_time(ts),
    }


def week_of_month(day: Column) -> Column:
    out = F.when(day <= WEEK_BANDS[0], 1)
    for number, last in enumerate(WEEK_BANDS[1:], start=2):
        out = out.when(day <= last, number)
    return out


def month_name(number: Column) -> Column:
    return F.get(_texts(MONTH_NAMES), number - 1)


def day_name(number: Column) -> Column:
    return F.get(_texts(DAY_NAMES), number)
