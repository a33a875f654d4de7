"""Column names and types of the two tables the library works on.

``EVENT`` is one row per user action, ``SESSION`` one row per session.  Names
are part of the data model and stay as users of such tables know them.
"""

from pyspark.sql import types as T

USER, SESSION, TIME, TYPE, EVENT_ID = "user_id", "session", "event_time", "event_type", "event_id"
#: A session is identified by this pair; the text form is for output only.
SESSION_KEY = [USER, SESSION]
SESSION_TEXT = "user_session_id_new"
LABEL = "PurchaseSession"

#: Wide enough for any price and its sums, with more places than prices have.
MONEY = T.DecimalType(24, 6)

#: Raw events as they arrive.  ``event_id`` only breaks ties between equal times.
EVENT = T.StructType(
    [
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField(TYPE, T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField(USER, T.LongType()),
        T.StructField("user_session", T.StringType()),
        T.StructField(EVENT_ID, T.LongType()),
    ]
)

CATEGORY_LEVELS = ["parentProductCategory", "secondaryProductCategory", "thirdProductCategory"]

#: Columns added to an event by ``features.enrich``.
DERIVED = T.StructType(
    [
        T.StructField(SESSION, T.LongType()),
        T.StructField(SESSION_TEXT, T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("weekDay", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("weekDayOrNot", T.BooleanType()),
        T.StructField("dayTime", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in CATEGORY_LEVELS],
        T.StructField("newVisitorOrNot", T.BooleanType()),
        T.StructField(LABEL, T.IntegerType()),
        T.StructField("set", T.StringType()),
    ]
)

#: Attributes a session takes from its first event.
FIRST_EVENT_ATTRIBUTES = [
    SESSION_TEXT, TIME, "day", "month", "weekDay", "hour", "weekDayOrNot", "dayTime", "newVisitorOrNot",
]

# Session features in table order, which decides which column of a
# correlated pair is the later one.  Durations are in microseconds.
FEATURES = {
    "number_of_views": T.LongType(),
    "number_of_carts": T.LongType(),
    "number_of_purchases": T.LongType(),
    "number_of_total_events_per_session_view_cart": T.LongType(),
    "total_value_of_views": T.DoubleType(),
    "total_value_of_carts": T.DoubleType(),
    "number_of_unique_views": T.LongType(),
    "number_of_unique_carts": T.LongType(),
    "number_of_unique_views_first_category_level": T.LongType(),
    "number_of_unique_views_second_category_level": T.LongType(),
    "number_of_unique_views_third_category_level": T.LongType(),
    "number_of_unique_carts_first_category_level": T.LongType(),
    "number_of_unique_carts_second_category_level": T.LongType(),
    "number_of_unique_carts_third_category_level": T.LongType(),
    "session_length": T.LongType(),
    "max_time_between_two_events": T.LongType(),
    "average_value_of_views": T.DoubleType(),
    "average_value_of_carts": T.DoubleType(),
}

DURATIONS = ["session_length", "max_time_between_two_events"]

SESSIONS = T.StructType(
    [
        T.StructField(USER, T.LongType()),
        T.StructField(SESSION, T.LongType()),
        T.StructField(SESSION_TEXT, T.StringType()),
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("weekDay", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("weekDayOrNot", T.BooleanType()),
        T.StructField("dayTime", T.StringType()),
        T.StructField("newVisitorOrNot", T.BooleanType()),
        *[T.StructField(c, kind) for c, kind in FEATURES.items()],
        T.StructField(LABEL, T.IntegerType()),
        T.StructField("set", T.StringType()),
    ]
)
