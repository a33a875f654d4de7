"""Sessions of users: cutting, numbering, filtering, ordering.

A session ends where a user pauses for more than the gap.  Two events within
one clock cell as long as the gap are never further apart than the gap, so a
cell belongs to one session as a whole.  All decisions on sessions are
therefore taken on one small row per user and cell, which map-side aggregation
makes before anything is shuffled: a user or a robot session holding a third
of all events is reduced to at most one row per cell.  The events
then look up their cell in an equi-join on ``(user, cell)`` whose lookup side
has unique keys; adaptive execution splits that join where a cell is hot.

After the size filter a session has at most ``max_events`` events, so windows
over ``(user, session)`` are bounded from there on.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.functions.durations import duration_us, epoch_us, micros_of
from clicktrail.functions.text import session_text_id

# The session rules.
GAP = "30 minutes"
MIN_EVENTS = 2
MAX_EVENTS = 100
COUNTED_TYPES = ("view", "cart")

_CELL = "_cell"


def _cell(ts: Column, gap_us: int) -> Column:
    micros = epoch_us(ts)
    return micros - F.pmod(micros, F.lit(gap_us))


def session_cells(df: DataFrame, gap=GAP, user=S.USER, ts=S.TIME, measures: dict | None = None) -> DataFrame:
    """One row per user and clock cell with its session number and additive measures."""
    gap_us = micros_of(gap)
    cells = df.groupBy(user, _cell(F.col(ts), gap_us).alias(_CELL)).agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        *[m.alias(name) for name, m in (measures or {}).items()],
    )
    in_order = Window.partitionBy(user).orderBy(_CELL)
    pause = duration_us(F.lag("_last").over(in_order), F.col("_first"))
    return (
        cells.withColumn("_cut", F.coalesce(pause > gap_us, F.lit(False)).cast("bigint"))
        .withColumn(S.SESSION, F.sum("_cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_cut")
    )


def _look_up(df: DataFrame, cells: DataFrame, gap, user, ts, how: str) -> DataFrame:
    columns = [c for c in df.columns if c != S.SESSION] + [S.SESSION]
    keyed = df.drop(S.SESSION).withColumn(_CELL, _cell(F.col(ts), micros_of(gap)))
    return keyed.join(cells.select(user, _CELL, S.SESSION), [user, _CELL], how).select(columns)


def sessionize(df: DataFrame, gap=GAP, user=S.USER, ts=S.TIME) -> DataFrame:
    """Add ``session``, numbered from 0 per user; a new one after a pause longer than the gap.

    The cut depends on times only, so equal times need no tie-break.  Rows
    without user or time keep a NULL session.
    """
    return _look_up(df, session_cells(df, gap, user, ts), gap, user, ts, "left")


def _filtered_cells(df: DataFrame, gap, required, counted, min_events, max_events) -> DataFrame:
    """Cells with whole-session totals and the outcome of each session filter."""
    measures = {
        "_all": F.count(F.lit(1)),
        "_required": F.count_if(F.col(S.TYPE) == required),
        "_counted": F.count_if(F.col(S.TYPE).isin(list(counted))),
    }
    cells = session_cells(df, gap, measures=measures)
    whole = Window.partitionBy(*S.SESSION_KEY)
    totals = {f"{name}_total": F.sum(name).over(whole) for name in measures}
    return cells.withColumns(totals).withColumns(
        {
            "_has_required": F.col("_required_total") > 0,
            "_large_enough": F.col("_counted_total") >= min_events,
            "_small_enough": F.col("_all_total") <= max_events,
        }
    )


def prepare_sessions(
    df: DataFrame, gap=GAP, required="view", counted=COUNTED_TYPES, min_events=MIN_EVENTS, max_events=MAX_EVENTS
) -> DataFrame:
    """Sessionise, drop sessions the filters reject, renumber the rest from 0 per user.

    All of it happens on cells; the events are joined once, to the cells that
    are kept.  Removing whole sessions only widens pauses, hence renumbering
    equals cutting the remaining events again.
    """
    cells = _filtered_cells(df, gap, required, counted, min_events, max_events)
    kept = cells.filter("_has_required AND _large_enough AND _small_enough")
    per_user = Window.partitionBy(S.USER).orderBy(S.SESSION)
    kept = kept.withColumn(S.SESSION, (F.dense_rank().over(per_user) - 1).cast("bigint"))
    return _look_up(df, kept, gap, S.USER, S.TIME, "inner")


def filter_report(
    df: DataFrame, gap=GAP, required="view", counted=COUNTED_TYPES, min_events=MIN_EVENTS, max_events=MAX_EVENTS
) -> DataFrame:
    """Sessions and events left after each filter: ``(step_no, step, sessions, events)``."""
    cells = _filtered_cells(df, gap, required, counted, min_events, max_events)
    sessions = cells.groupBy(*S.SESSION_KEY).agg(
        F.sum("_all").alias("_n"),
        *[F.first(c).alias(c) for c in ("_has_required", "_large_enough", "_small_enough")],
    )
    steps = {
        "input": F.lit(True),
        "required": F.col("_has_required"),
        "min_events": F.col("_has_required") & F.col("_large_enough"),
        "max_events": F.col("_has_required") & F.col("_large_enough") & F.col("_small_enough"),
    }
    wide = sessions.agg(
        *[F.count_if(keep).alias(f"{step}_sessions") for step, keep in steps.items()],
        *[F.coalesce(F.sum(F.when(keep, F.col("_n"))), F.lit(0)).alias(f"{step}_events") for step, keep in steps.items()],
    )
    rows = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(step).alias("step"),
            F.col(f"{step}_sessions").alias("sessions"),
            F.col(f"{step}_events").alias("events"),
        )
        for i, step in enumerate(steps)
    ]
    return wide.select(F.inline(F.array(*rows)))


def session_key(df: DataFrame) -> DataFrame:
    """Add the text form of the session key."""
    return df.withColumn(S.SESSION_TEXT, session_text_id(F.col(S.USER), F.col(S.SESSION)))


def renumber_sessions(df: DataFrame) -> DataFrame:
    """Number the sessions that are left densely from 0 per user.

    Ranks one row per session, then joins the new number to the events.
    """
    per_user = Window.partitionBy(S.USER).orderBy(S.SESSION)
    numbers = df.select(*S.SESSION_KEY).distinct().withColumn(
        "_number", (F.dense_rank().over(per_user) - 1).cast("bigint")
    )
    joined = df.join(numbers, S.SESSION_KEY)
    return joined.withColumn(S.SESSION, F.col("_number")).select(df.columns)


# Whole-session filters on events that already carry a session number.  Each
# counts per session with map-side aggregation and semi-joins the events.


def _sessions_where(df: DataFrame, condition: Column) -> DataFrame:
    keys = df.groupBy(*S.SESSION_KEY).agg(condition.alias("_keep")).filter("_keep")
    return df.join(keys.select(*S.SESSION_KEY), S.SESSION_KEY, "left_semi").select(df.columns)


def sessions_with(df: DataFrame, event_type: str, minimum: int = 1) -> DataFrame:
    return _sessions_where(df, F.count_if(F.col(S.TYPE) == event_type) >= minimum)


def sessions_min_events(df: DataFrame, types=COUNTED_TYPES, minimum: int = MIN_EVENTS) -> DataFrame:
    return _sessions_where(df, F.count_if(F.col(S.TYPE).isin(list(types))) >= minimum)


def sessions_max_events(df: DataFrame, maximum: int = MAX_EVENTS) -> DataFrame:
    return _sessions_where(df, F.count(F.lit(1)) <= maximum)


def sessions_starting_with(df: DataFrame, event_type: str = "view") -> DataFrame:
    first = F.min_by(F.col(S.TYPE), F.struct(S.TIME, S.EVENT_ID))
    return _sessions_where(df, first == event_type)


def first_event(df: DataFrame) -> DataFrame:
    """Type, time and product of each session's first event."""
    columns = [S.TYPE, S.TIME, S.EVENT_ID, "product_id"]
    first = F.min_by(F.struct(*columns), F.struct(S.TIME, S.EVENT_ID))
    return df.groupBy(*S.SESSION_KEY).agg(first.alias("_first")).select(*S.SESSION_KEY, "_first.*")


# Sequence columns.  They expect sessions of bounded size, see
# ``prepare_sessions``; ``keys`` adds the copy number of replicated sessions.


def session_order(keys=None):
    return Window.partitionBy(*(keys or S.SESSION_KEY)).orderBy(S.TIME, S.EVENT_ID)


def timed(exclude_types=()) -> Column:
    """Time of an event that counts for durations, NULL for the types left out."""
    return F.when(~F.coalesce(F.col(S.TYPE).isin(list(exclude_types)), F.lit(False)), F.col(S.TIME)) if exclude_types else F.col(S.TIME)


def event_gaps(df: DataFrame, name: str = "gap_us", keys=None, exclude_types=()) -> DataFrame:
    """Microseconds since the previous event of the session, 0 for the first.

    Events of ``exclude_types`` have no gap (NULL), and the event behind them looks past them.
    """
    if exclude_types:
        time = timed(exclude_types)
        before = F.max(time).over(session_order(keys).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, F.when(time.isNotNull(), F.coalesce(duration_us(before, time), F.lit(0))))
    pause = duration_us(F.lag(S.TIME).over(session_order(keys)), F.col(S.TIME))
    return df.withColumn(name, F.coalesce(pause, F.lit(0)))


def event_position(df: DataFrame, name: str = "position", keys=None) -> DataFrame:
    """0-based ordinal of an event in its session."""
    return df.withColumn(name, F.row_number().over(session_order(keys)) - 1)


def factorize(df: DataFrame, column: str = "product_id", name: str = "code", keys=None) -> DataFrame:
    """0-based code of a value by its first appearance in the session."""
    keys = list(keys or S.SESSION_KEY)
    placed = event_position(df, "_position", keys)
    first = placed.withColumn("_first", F.min("_position").over(Window.partitionBy(*keys, column)))
    coded = first.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1)
    return coded.drop("_position", "_first")


def consecutive_pairs(df: DataFrame, node: str, keys=None) -> DataFrame:
    """Pairs of neighbouring events: ``(keys, src, dst, seq)`` with ``seq`` counting from 0."""
    keys = list(keys or S.SESSION_KEY)
    order = session_order(keys)
    pairs = df.select(
        *keys,
        F.col(node).alias("src"),
        F.lead(node).over(order).alias("dst"),
        F.lead(S.EVENT_ID).over(order).alias("_next"),
        (F.row_number().over(order) - 1).alias("seq"),
    )
    return pairs.filter(F.col("_next").isNotNull()).drop("_next")
