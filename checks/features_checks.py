"""Per-session aggregates, session table, labels, reports and exploratory tables."""

from itertools import combinations

from pyspark.sql import functions as F

from checks.base import (
    FEATURE_SQL, KEY, ORDER, check, clicks, enriched, feature_list, kept, labelled, numbered, over_clicks, over_sessions,
    over_split, session_rows, split_tables, train_events, train_sessions,
)
from clicktrail import schemas as S
from clicktrail.operators import eda, features, rows
from clicktrail.plans import flows
from clicktrail.spark import materialize

ROUNDED = ["average_value_of_views", "average_value_of_carts"]


def rounded(df, columns=ROUNDED, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@check("session_summary", over_sessions(f"""SELECT {KEY}, {feature_list('number_of_views', 'number_of_carts', 'number_of_purchases', 'session_length')},
  COUNT(*) AS events, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS "PurchaseSession" FROM kept GROUP BY {KEY}"""))
def session_summary(spark, folder):
    return features.per_session(
        kept(spark, folder), **features.event_counts(), session_length=features.session_length(),
        events=features.total_events(), PurchaseSession=features.purchase_label())


@check("event_counts", over_sessions(
    f"SELECT {KEY}, {feature_list('number_of_views', 'number_of_carts', 'number_of_purchases')} FROM numbered GROUP BY {KEY}"))
def event_counts(spark, folder):
    return features.per_session(numbered(spark, folder), **features.event_counts())


@check("total_events", over_sessions(f"SELECT {KEY}, COUNT(*) AS events FROM numbered GROUP BY {KEY}"))
def total_events(spark, folder):
    return features.per_session(numbered(spark, folder), events=features.total_events())


@check("view_cart_events", over_sessions(
    f"SELECT {KEY}, COUNT(CASE WHEN event_type IN ('view', 'cart') THEN 1 END) AS events FROM numbered GROUP BY {KEY}"))
def view_cart_events(spark, folder):
    return features.per_session(numbered(spark, folder), events=features.count_types(["view", "cart"]))


@check("distinct_products", over_sessions(
    f"SELECT {KEY}, {feature_list('number_of_unique_views', 'number_of_unique_carts')} FROM kept GROUP BY {KEY}"))
def distinct_products(spark, folder):
    return features.per_session(
        kept(spark, folder), number_of_unique_views=features.distinct_by_type("product_id", "view"),
        number_of_unique_carts=features.distinct_by_type("product_id", "cart"))


LEVEL_NAMES = [n for n in FEATURE_SQL if n.endswith("_category_level")]


@check("distinct_categories", over_sessions(f"SELECT {KEY}, {feature_list(*LEVEL_NAMES)} FROM enriched GROUP BY {KEY}"))
def distinct_categories(spark, folder):
    wanted = {}
    for word, level in zip(("first", "second", "third"), S.CATEGORY_LEVELS):
        for kind in ("view", "cart"):
            wanted[f"number_of_unique_{kind}s_{word}_category_level"] = features.distinct_by_type(level, kind)
    return features.per_session(enriched(spark, folder), **wanted)


@check("session_values", over_sessions(
    f"SELECT {KEY}, {feature_list('total_value_of_views', 'total_value_of_carts')} FROM kept GROUP BY {KEY}"))
def session_values(spark, folder):
    return features.per_session(
        kept(spark, folder), total_value_of_views=features.value_by_type("view"),
        total_value_of_carts=features.value_by_type("cart"))


@check("average_values", over_sessions(f"SELECT {KEY}, {feature_list(*ROUNDED)} FROM kept GROUP BY {KEY}"))
def average_values(spark, folder):
    return rounded(features.per_session(
        kept(spark, folder), average_value_of_views=features.avg_value_by_type("view"),
        average_value_of_carts=features.avg_value_by_type("cart")))


@check("session_span", over_sessions(
    f'SELECT {KEY}, MIN(event_time) AS "first", MAX(event_time) AS "last", {feature_list("session_length")} FROM numbered GROUP BY {KEY}'))
def session_span(spark, folder):
    return features.session_span(numbered(spark, folder))


@check("new_visitor", over_sessions('SELECT event_id, session = 0 AS "newVisitorOrNot" FROM kept'))
def new_visitor(spark, folder):
    return features.new_visitor(kept(spark, folder)).select("event_id", "newVisitorOrNot")


@check("max_gap", over_sessions(f"""SELECT {KEY}, MAX(gap) AS max_time_between_two_events FROM (SELECT {KEY},
  COALESCE(date_diff('microsecond', LAG(event_time) OVER ({ORDER}), event_time), 0) AS gap FROM kept) GROUP BY {KEY}"""))
def max_gap(spark, folder):
    return features.max_gap(kept(spark, folder))


@check("session_durations_without_purchases", over_sessions(f"""SELECT {KEY}, CAST(date_diff('microsecond', MIN(event_time), MAX(event_time)) AS BIGINT) AS session_length,
  MAX(gap) AS max_time_between_two_events, ANY_VALUE("PurchaseSession") AS "PurchaseSession" FROM (SELECT *,
    COALESCE(date_diff('microsecond', LAG(event_time) OVER ({ORDER}), event_time), 0) AS gap FROM labelled WHERE event_type <> 'purchase') GROUP BY {KEY}"""))
def session_durations_without_purchases(spark, folder):
    table = features.session_table(labelled(spark, folder), exclude_types=["purchase"])
    return table.select(*S.SESSION_KEY, "session_length", "max_time_between_two_events", S.LABEL)


def _list_sql(column, kind):
    return f"COALESCE(STRING_AGG(CASE WHEN event_type = '{kind}' THEN CAST({column} AS VARCHAR) END, ',' ORDER BY event_time, event_id), '')"


@check("product_lists", over_sessions(f"""SELECT {KEY}, {_list_sql('product_id', 'view')} AS viewed, {_list_sql('product_id', 'cart')} AS carted,
  {_list_sql('product_id', 'purchase')} AS purchased FROM kept GROUP BY {KEY}"""))
def product_lists(spark, folder):
    lists = {name: features.values_by_type("product_id", kind) for name, kind in
             (("viewed", "view"), ("carted", "cart"), ("purchased", "purchase"))}
    df = features.per_session(kept(spark, folder), **lists)
    return df.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in lists})


@check("category_lists", over_sessions("SELECT " + KEY + ", " + ", ".join(
    f"""{_list_sql(f'"{c}"', kind)} AS {kind}_{i}""" for i, c in enumerate(S.CATEGORY_LEVELS) for kind in ("view", "cart")) + f" FROM enriched GROUP BY {KEY}"))
def category_lists(spark, folder):
    lists = {f"{kind}_{i}": features.values_by_type(c, kind) for i, c in enumerate(S.CATEGORY_LEVELS) for kind in ("view", "cart")}
    df = features.per_session(enriched(spark, folder), **lists)
    return df.withColumns({c: F.concat_ws(",", c) for c in lists})


@check("purchase_label", over_sessions(
    f"""SELECT {KEY}, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS "PurchaseSession" FROM numbered GROUP BY {KEY}"""))
def purchase_label(spark, folder):
    return features.per_session(numbered(spark, folder), PurchaseSession=features.purchase_label())


@check("session_table", over_sessions("SELECT * FROM sess"))
def session_table(spark, folder):
    return rounded(session_rows(spark, folder))


@check("session_table_30_minutes", over_sessions("SELECT * FROM sess", "30 minutes"))
def session_table_30_minutes(spark, folder):
    return rounded(session_rows(spark, folder, "30 minutes"))


@check("enriched_events", over_sessions("SELECT * EXCLUDE (price) FROM enriched"))
def enriched_events(spark, folder):
    return enriched(spark, folder).drop("price")


@check("label_events_by_join", over_sessions("""SELECT event_id, "PurchaseSession" FROM labelled"""))
def label_events_by_join(spark, folder):
    events = labelled(spark, folder)
    return features.label_events(events, features.session_table(events)).select("event_id", "PurchaseSession")


@check("label_events_by_window", over_sessions(
    f"""SELECT event_id, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY}) AS "PurchaseSession" FROM kept"""))
def label_events_by_window(spark, folder):
    return features.label_events(kept(spark, folder)).select("event_id", "PurchaseSession")


@check("assign_set_events", over_split('SELECT event_id, "set" FROM marked_events'))
def assign_set_events(spark, folder):
    return split_tables(spark, folder)[0].select("event_id", "set")


@check("distinct_counts", over_sessions(
    f"SELECT COUNT(DISTINCT ({KEY})) AS sessions, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT product_id) AS products FROM numbered"))
def distinct_counts(spark, folder):
    return features.distinct_counts(numbered(spark, folder), sessions=S.SESSION_KEY, users=["user_id"], products=["product_id"])


@check("distinct_sketches", over_clicks("""SELECT 'products' AS name, COUNT(DISTINCT product_id) AS exact, TRUE AS near FROM clicks WHERE event_time < TIMESTAMP '2100-01-01'
UNION ALL SELECT 'users', COUNT(DISTINCT user_id), TRUE FROM clicks"""))
def distinct_sketches(spark, folder):
    """Stored sketches of the days, joined, beside the exact counts: within four standard errors."""
    df = clicks(spark, folder)
    keys = {"products": ["product_id"], "users": ["user_id"]}
    stored = materialize(features.distinct_sketches(df, **keys), "sketches")
    both = features.distinct_from_sketches(stored).crossJoin(features.distinct_counts(df, **keys).withColumnsRenamed({k: f"{k}_exact" for k in keys}))
    rows_of = [F.struct(F.lit(k).alias("name"), F.col(f"{k}_exact").alias("exact"),
                        (F.abs(F.col(k) - F.col(f"{k}_exact")) <= F.ceil(0.026 * F.col(f"{k}_exact"))).alias("near")) for k in keys]
    return both.select(F.inline(F.array(*rows_of)))


@check("date_range", over_clicks("SELECT MIN(event_time) AS first_date, MAX(event_time) AS last_date FROM clicks"))
def date_range(spark, folder):
    return features.date_range(clicks(spark, folder))


PER_TRAIN = f""",
per AS (SELECT {KEY}, COUNT(*) AS n, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS b FROM train_events GROUP BY {KEY})"""


@check("train_statistics", over_split("""SELECT (SELECT MIN(event_time) FROM train_events) AS first_date,
  (SELECT MAX(event_time) FROM train_events) AS last_date, CAST(SUM(n) AS BIGINT) AS events, COUNT(*) AS sessions,
  COUNT(DISTINCT user_id) AS users, COUNT(CASE WHEN n = 1 THEN 1 END) AS single_event_sessions,
  ROUND(COUNT(CASE WHEN n = 1 THEN 1 END) * 100.0e0 / COUNT(*), 6) AS single_event_percent,
  ROUND(SUM(n) * 1.0e0 / COUNT(*), 6) AS events_per_session, CAST(SUM(b) AS BIGINT) AS purchase_sessions,
  ROUND(SUM(b) * 100.0e0 / COUNT(*), 6) AS purchase_percent, (SELECT COUNT(*) FROM train) AS session_table_rows FROM per""", PER_TRAIN))
def train_statistics(spark, folder):
    df = features.train_statistics(*split_tables(spark, folder))
    return rounded(df, ["single_event_percent", "events_per_session", "purchase_percent"])


@check("class_ratio", over_sessions("""SELECT COUNT(CASE WHEN b = 1 THEN 1 END) AS positives, COUNT(CASE WHEN b = 0 THEN 1 END) AS negatives,
  ROUND(COUNT(CASE WHEN b = 1 THEN 1 END) * 1.0e0 / NULLIF(COUNT(CASE WHEN b = 0 THEN 1 END), 0), 6) AS ratio
  FROM (SELECT "PurchaseSession" AS b FROM sess)"""))
def class_ratio(spark, folder):
    return rounded(features.class_ratio(labelled(spark, folder)), ["ratio"])


@check("tabular_frame", over_sessions(f"""SELECT {KEY}, ['January','February','March','April','May','June','July','August','September','October','November','December']["month"] AS "month",
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']["weekDay" + 1] AS week_day, CAST("weekDayOrNot" AS INTEGER) AS week_day_or_not,
  "dayTime" AS day_time, CAST("newVisitorOrNot" AS INTEGER) AS new_visitor_or_not, {', '.join(n for n in S.FEATURES if n != 'number_of_purchases' and n not in ('session_length', 'max_time_between_two_events'))},
  (session_length // 1000000) % 86400 AS session_length, (max_time_between_two_events // 1000000) % 86400 AS max_time_between_two_events,
  "PurchaseSession" AS purchase_session,
  CASE WHEN "day" <= 7 THEN 1 WHEN "day" <= 15 THEN 2 WHEN "day" <= 22 THEN 3 ELSE 4 END AS week_of_the_month FROM sess"""))
def tabular_frame(spark, folder):
    return rounded(flows.tabular_frame(session_rows(spark, folder)))


# Exploratory tables


@check("day_time_frequency", over_split('SELECT "dayTime", COUNT(*) AS "count" FROM train GROUP BY 1'))
def day_time_frequency(spark, folder):
    return eda.freq(train_sessions(spark, folder), "dayTime")


def _top(name, column):
    @check(name, over_split(f'SELECT "{column}", COUNT(*) AS "count" FROM train_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40'))
    def top(spark, folder):
        return eda.top_values(train_events(spark, folder), column)


_top("top_parent_categories", "parentProductCategory")
_top("top_secondary_categories", "secondaryProductCategory")
_top("top_third_categories", "thirdProductCategory")
_top("top_brands", "brand")


@check("top_products_all_events", over_clicks('SELECT product_id, COUNT(*) AS "count" FROM clicks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40'))
def top_products_all_events(spark, folder):
    return eda.top_values(clicks(spark, folder), "product_id")


def _histogram(name, column):
    @check(name, over_split(f'SELECT {column}, COUNT(*) AS "count" FROM train WHERE {column} < 16 GROUP BY 1'))
    def histogram(spark, folder):
        return eda.count_histogram(train_sessions(spark, folder), column)


_histogram("event_count_histogram", "number_of_total_events_per_session_view_cart")
_histogram("view_count_histogram", "number_of_views")


@check("daily_sessions", over_split("SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS \"day\", COUNT(*) AS \"count\" FROM train GROUP BY 1"))
def daily_sessions(spark, folder):
    return eda.daily_counts(train_sessions(spark, folder))


@check("daily_purchase_sessions", over_split(
    "SELECT CAST(date_trunc('day', event_time) AS TIMESTAMP) AS \"day\", COUNT(*) AS \"count\" FROM train WHERE \"PurchaseSession\" = 1 GROUP BY 1"))
def daily_purchase_sessions(spark, folder):
    return eda.daily_counts(train_sessions(spark, folder), purchases_only=True)


@check("hour_type_histogram", over_split(
    """SELECT "hour", event_type, COUNT(*) AS "count" FROM train_events WHERE event_type IN ('purchase', 'cart', 'view') GROUP BY 1, 2"""))
def hour_type_histogram(spark, folder):
    return eda.hour_type_histogram(train_events(spark, folder))


def _kde(name, column, high, source, frame):
    step = float(high) / (eda.GRID_POINTS - 1)

    width = f"(CAST('{high / eda.BINS!r}' AS DOUBLE) * POW(2.0e0, k))"
    @check(name, over_split(f"""SELECT ROUND(x, 6) AS x, ROUND(SUM((n - r) * EXP(-0.5e0 * POW((x - a) / h, 2)) + r * EXP(-0.5e0 * POW((x - a - w) / h, 2)))
        / (ANY_VALUE(total) * ANY_VALUE(h) * SQRT(2 * PI())), 9) AS density FROM ends, spread, grid GROUP BY x""", f""",
      vals AS ({source}),
      spread AS (SELECT COUNT(*) AS total, STDDEV_SAMP(v) * POW(COUNT(*), -0.2e0) AS h FROM vals),
      octaves AS (SELECT v, GREATEST(COALESCE(FLOOR(LOG2(NULLIF(ABS(v - {high / 2!r}e0) / {high}e0, 0))), 0), 0) AS k FROM vals WHERE v IS NOT NULL),
      cells AS (SELECT {width} AS w, FLOOR(v / {width}) * {width} AS a, COUNT(*) AS n, AVG(v) AS mean FROM octaves GROUP BY 1, 2),
      ends AS (SELECT *, n * (mean - a) / w AS r FROM cells),
      grid AS (SELECT CAST(i AS DOUBLE) * CAST('{step!r}' AS DOUBLE) AS x FROM range({eda.GRID_POINTS}) t(i))"""))
    def density(spark, folder):
        return rounded(rounded(eda.kde(frame(spark, folder), column, 0, high), ["x"]), ["density"], 9)


def _session_seconds(spark, folder):
    return flows.tabular_frame(train_sessions(spark, folder))


def _first_products(spark, folder):
    return rows.dedupe_first(
        train_events(spark, folder).select("product_id", "event_time", "event_id", "price"), ["product_id"], ["event_time", "event_id"])


_kde("session_length_density", "session_length", 4500,
     "SELECT CAST((session_length // 1000000) % 86400 AS DOUBLE) AS v FROM train", _session_seconds)
_kde("max_gap_density", "max_time_between_two_events", 2500,
     "SELECT CAST((max_time_between_two_events // 1000000) % 86400 AS DOUBLE) AS v FROM train", _session_seconds)
_kde("price_density", "price", 1000,
     "SELECT CAST(price AS DOUBLE) AS v FROM train_events QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY event_time, event_id) = 1",
     _first_products)
_kde("average_view_value_density", "average_value_of_views", 1000, "SELECT average_value_of_views AS v FROM train",
     lambda spark, folder: rounded(train_sessions(spark, folder)))


def correlation_sql(columns, source, digits=6):
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]

    def pair(a, b):
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        return (f"ROUND(COVAR_POP({x}, {y}) / NULLIF((STDDEV_POP({x}) FILTER ({both})) * (STDDEV_POP({y}) FILTER ({both})), 0), {digits})")

    wide = ", ".join(f"{pair(a, b)} AS r{i}" for i, (a, b) in enumerate(pairs))
    long = " UNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, r{i} AS r FROM wide" for i, (a, b) in enumerate(pairs) for x, y in sorted({(a, b), (b, a)}))
    return f", wide AS MATERIALIZED (SELECT {wide} FROM {source})", long


EDA_COLUMNS = [*S.FEATURES, "PurchaseSession"]
_extra, _long = correlation_sql([f'"{c}"' if c == "PurchaseSession" else c for c in EDA_COLUMNS], "train")


@check("correlation_matrix", over_split(_long.replace("'\"", "'").replace("\"'", "'"), _extra))
def correlation_matrix(spark, folder):
    return rounded(eda.correlation_matrix(train_sessions(spark, folder), EDA_COLUMNS), ["r"])


# hour is always present; category and brand codes are missing for a part of the events
_extra_n, _long_n = correlation_sql(["product_id", "category_id", "price", "user_id"], "clicks")


@check("correlation_matrix_with_nulls", f"WITH x AS (SELECT 1), {over_clicks('')[5:]}{_extra_n} {_long_n}")
def correlation_matrix_with_nulls(spark, folder):
    from clicktrail.sources.testdata import clickstream

    return rounded(eda.correlation_matrix(clickstream(spark, folder), ["product_id", "category_id", "price", "user_id"]), ["r"])
