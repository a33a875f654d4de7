"""Event features, per-session aggregates and the session table.

Functions that return a ``Column`` are aggregates for one
``groupBy(user_id, session)``; ``session_table`` fuses all of them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.functions.calendar import calendar_parts
from clicktrail.functions.durations import duration_us
from clicktrail.functions.text import category_levels, session_text_id
from clicktrail.operators.rows import fill_unknown
from clicktrail.operators.sessions import COUNTED_TYPES, event_gaps, session_order, timed


# Event level


def new_visitor(df: DataFrame) -> DataFrame:
    """Flag events of a user's first (surviving) session."""
    return df.withColumn("newVisitorOrNot", F.col(S.SESSION) == 0)


def enrich(df: DataFrame) -> DataFrame:
    """Text id, calendar, category levels, NULL texts and visitor flag of sessionised events."""
    columns = {
        S.SESSION_TEXT: session_text_id(F.col(S.USER), F.col(S.SESSION)),
        **calendar_parts(F.col(S.TIME)),
        **category_levels(F.col("category_code")),
    }
    return new_visitor(fill_unknown(df.withColumns(columns)))


# Aggregates of one session


def _of(event_type: str) -> Column:
    return F.col(S.TYPE) == event_type


def count_of(event_type: str) -> Column:
    """Events of a type, 0 for sessions without any."""
    return F.count_if(_of(event_type))


def event_counts(types=("view", "cart", "purchase")) -> dict:
    return {f"number_of_{t}s": count_of(t) for t in types}


def total_events() -> Column:
    return F.count(F.lit(1))


def count_types(types=COUNTED_TYPES) -> Column:
    return F.count_if(F.col(S.TYPE).isin(list(types)))


def distinct_by_type(column: str, event_type: str) -> Column:
    """Distinct values among a session's events of a type.

    A set of a bounded session; eight ``count(DISTINCT)`` in one aggregate would
    expand every row eightfold and shuffle twice more.
    """
    return F.size(F.collect_set(F.when(_of(event_type), F.col(column)))).cast("bigint")


def value_by_type(event_type: str) -> Column:
    """Summed price, exact as long as the price is a DECIMAL."""
    return F.coalesce(F.sum(F.when(_of(event_type), F.col("price"))), F.lit(0)).cast("double")


def avg_value_by_type(event_type: str) -> Column:
    n = count_of(event_type)
    return F.when(n > 0, F.try_divide(value_by_type(event_type), n)).otherwise(F.lit(0.0))


def first_time() -> Column:
    return F.min(S.TIME)


def last_time() -> Column:
    return F.max(S.TIME)


def session_length(exclude_types=()) -> Column:
    """From the first to the last event, 0 if all are of ``exclude_types``."""
    time = timed(exclude_types)
    return F.coalesce(duration_us(F.min(time), F.max(time)), F.lit(0)) if exclude_types else duration_us(first_time(), last_time())


def purchase_label() -> Column:
    return (count_of("purchase") > 0).cast("int")


def values_by_type(column: str, event_type: str) -> Column:
    """Values of a session's events of a type in time order, duplicates kept."""
    entry = F.when(_of(event_type) & F.col(column).isNotNull(), F.struct(S.TIME, S.EVENT_ID, column))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e[column])


def per_session(df: DataFrame, **columns: Column) -> DataFrame:
    """One row per session with the given aggregates."""
    return df.groupBy(*S.SESSION_KEY).agg(*[c.alias(name) for name, c in columns.items()])


def session_span(df: DataFrame) -> DataFrame:
    return per_session(df, first=first_time(), last=last_time(), session_length=session_length())


def max_gap(df: DataFrame, exclude_types=()) -> DataFrame:
    """Longest pause inside each session, purchases included unless ``exclude_types`` leaves them out."""
    return per_session(event_gaps(df, "_gap", exclude_types=exclude_types), max_time_between_two_events=F.coalesce(F.max("_gap"), F.lit(0)))


def _level_counts() -> dict:
    levels = zip(("first", "second", "third"), S.CATEGORY_LEVELS)
    return {
        f"number_of_unique_{t}s_{word}_category_level": distinct_by_type(level, t)
        for word, level in levels
        for t in COUNTED_TYPES
    }


def session_table(df: DataFrame, exclude_types=()) -> DataFrame:
    """One row per session: first-event attributes, counts, values, durations and label.

    Needs enriched events.  The pause window and the aggregate share one
    exchange on the session key.  Durations leave out events of ``exclude_types``: a purchase tells the label, and it
    lengthens its session.
    """
    aggregates = {
        **event_counts(),
        "number_of_total_events_per_session_view_cart": count_types(),
        "number_of_unique_views": distinct_by_type("product_id", "view"),
        "number_of_unique_carts": distinct_by_type("product_id", "cart"),
        **_level_counts(),
        "total_value_of_views": value_by_type("view"),
        "total_value_of_carts": value_by_type("cart"),
        "average_value_of_views": avg_value_by_type("view"),
        "average_value_of_carts": avg_value_by_type("cart"),
        "session_length": session_length(exclude_types),
        "max_time_between_two_events": F.coalesce(F.max("_gap"), F.lit(0)),
        S.LABEL: purchase_label(),
    }
    first = F.min_by(F.struct(*S.FIRST_EVENT_ATTRIBUTES), F.struct(S.TIME, S.EVENT_ID))
    table = per_session(event_gaps(df, "_gap", exclude_types=exclude_types), _first=first, **aggregates)
    return table.select(*S.SESSION_KEY, "_first.*", *S.FEATURES, S.LABEL)


# Labels and lookups


def label_events(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Attach the session's purchase label to each event.

    With a session table this is an equi-join; without one a window over the
    session derives the label in place.
    """
    if sessions is None:
        bought = F.max(F.col(S.TYPE) == "purchase").over(Window.partitionBy(*S.SESSION_KEY))
        return events.withColumn(S.LABEL, bought.cast("int"))
    labels = sessions.select(*S.SESSION_KEY, S.LABEL)
    return events.drop(S.LABEL).join(labels, S.SESSION_KEY, "left")


def labelled_events(df: DataFrame, first_type: str = "view") -> DataFrame:
    """Enriched events of sessions that start with a view, with their label; one exchange."""
    started = F.first(S.TYPE).over(session_order())
    kept = df.withColumn("_start", started).filter(F.col("_start") == first_type).drop("_start")
    return label_events(kept)


def attach_graph_features(graphs: DataFrame, sessions: DataFrame, columns=("session_length",)) -> DataFrame:
    """Session attributes for graphs; replicas find those of their original by the key."""
    return graphs.join(sessions.select(*S.SESSION_KEY, *columns), S.SESSION_KEY, "left")


# Reports


def distinct_counts(df: DataFrame, exact: bool = True, **keys) -> DataFrame:
    """Number of distinct keys, e.g. ``users=["user_id"]``; one row."""
    aggregates = []
    for name, columns in keys.items():
        key = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
        count = F.count_distinct(key) if exact else F.approx_count_distinct(key)
        aggregates.append(count.alias(name))
    return df.agg(*aggregates)


#: Buckets of a distinct-count sketch, as a power of two: 16,384, a standard error of 0.65 %.
SKETCH_SIZE = 14


def distinct_sketches(df: DataFrame, day: Column | None = None, **keys) -> DataFrame:
    """A row per day with a mergeable sketch per key, e.g. ``users=["user_id"]``: ``day`` and a binary column for each.

    To be stored: a range of days, or a table that grows by days, is counted from its sketches alone (``distinct_from_sketches``).
    Keys are sketched by a 64-bit hash, which adds nothing to the error that counts; rows with a NULL in the key do not count.
    """
    aggregates = []
    for name, columns in keys.items():
        complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        aggregates.append(F.hll_sketch_agg(F.when(complete, F.xxhash64(*columns)), SKETCH_SIZE).alias(name))
    return df.groupBy((day if day is not None else F.to_date(S.TIME)).alias("day")).agg(*aggregates)


def distinct_from_sketches(sketches: DataFrame, first=None, last=None) -> DataFrame:
    """Estimated distinct keys of the days ``first`` to ``last``, both included, from stored sketches; one row."""
    if first is not None:
        sketches = sketches.filter(F.col("day") >= F.lit(first))
    if last is not None:
        sketches = sketches.filter(F.col("day") <= F.lit(last))
    names = [c for c in sketches.columns if c != "day"]
    return sketches.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("bigint")).alias(c) for c in names])


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(S.TIME).alias("first_date"), F.max(S.TIME).alias("last_date"))


def train_statistics(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of key figures of the train part.

    Events are reduced to one row per session before anything is counted; the
    session table only adds its own row count as a cross-check.
    """
    train = events.filter(F.col("set") == "train")
    per = train.groupBy(*S.SESSION_KEY).agg(
        total_events().alias("_n"),
        purchase_label().alias("_bought"),
        F.min(S.TIME).alias("_first"),
        F.max(S.TIME).alias("_last"),
    )
    n = F.count(F.lit(1))
    single = F.count_if(F.col("_n") == 1)
    figures = per.agg(
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events"),
        n.alias("sessions"),
        F.count_distinct(S.USER).alias("users"),
        single.alias("single_event_sessions"),
        (F.try_divide(single, n) * 100).alias("single_event_percent"),
        F.try_divide(F.sum("_n"), n).alias("events_per_session"),
        F.count_if(F.col("_bought") == 1).alias("purchase_sessions"),
        (F.try_divide(F.count_if(F.col("_bought") == 1), n) * 100).alias("purchase_percent"),
    )
    table_rows = sessions.filter(F.col("set") == "train").agg(F.count(F.lit(1)).alias("n"))
    return figures.withColumn("session_table_rows", table_rows.scalar())


def class_ratio(df: DataFrame, key=None, label: str = S.LABEL) -> DataFrame:
    """Sessions per class and their ratio minority : majority; NULL when a class is empty."""
    key = list(key or S.SESSION_KEY)
    labels = df.groupBy(*key).agg(F.max(label).alias("_label"))
    positives, negatives = F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") == 0)
    return labels.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.try_divide(positives, F.nullif(negatives, F.lit(0))).alias("ratio"),
    )


