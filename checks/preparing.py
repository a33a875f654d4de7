"""Sources, row operators, sessions, session filters."""

from pyspark.sql import functions as F

from checks.base import (
    GAP, KEY, ORDER, check, distinct_sql, kept, numbered, over_clicks,
    labelled, over_sessions, over_split, raw, session_rows, split_sessions,
)
from clicktrail import schemas as S
from clicktrail.functions import calendar, durations, text
from clicktrail.operators import features, rows, sessions
from clicktrail.sources import events as io
from clicktrail.sources.testdata import clicks, clickstream
from clicktrail.spark import new_path

# Sources and sinks

EVENT_TOTALS = """SELECT event_type, COUNT(*) AS n, COUNT(category_code) AS coded, COUNT(brand) AS branded,
  COUNT(user_session) AS with_session, CAST(SUM(product_id) AS BIGINT) AS products, CAST(SUM(price) AS DOUBLE) AS value,
  MIN(event_time) AS first_time, MAX(event_time) AS last_time FROM clicks GROUP BY event_type"""


def event_totals(df):
    n = F.count
    return df.groupBy("event_type").agg(
        n(F.lit(1)).alias("n"), n("category_code").alias("coded"), n("brand").alias("branded"),
        n("user_session").alias("with_session"), F.sum("product_id").alias("products"),
        F.sum("price").cast("double").alias("value"), F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


@check("fixture_events", over_clicks(EVENT_TOTALS))
def fixture_events(spark, folder):
    return event_totals(clickstream(spark, folder))


@check("read_events_csv", over_clicks(EVENT_TOTALS))
def read_events_csv(spark, folder):
    path = new_path(spark, "events-csv")
    zoned = clickstream(spark, folder).withColumn("event_time", F.concat(F.col("event_time").cast("string"), F.lit(" UTC")))
    io.write_table(zoned, path, "csv")
    return event_totals(io.read_events(spark, path, "csv"))


@check("read_rejects", over_clicks("""SELECT CASE WHEN event_id % 11 = 0 THEN 'unreadable event_time' WHEN event_id % 13 = 0 THEN 'more than 6 places in price' ELSE 'kept' END AS reason,
  COUNT(*) AS "rows" FROM clicks GROUP BY 1"""))
def read_rejects(spark, folder):
    """Rows per reason when some times and prices are spoiled; kept and rejected ones add up to all."""
    path = new_path(spark, "events-csv")
    time = F.when(F.col("event_id") % 11 == 0, "late").otherwise(F.col("event_time").cast("string"))
    price = F.concat(F.col("price").cast("decimal(20,6)").cast("string"), F.when((F.col("event_id") % 13 == 0) & (F.col("event_id") % 11 != 0), "1").otherwise(""))
    io.write_table(clickstream(spark, folder).withColumns({"event_time": time, "price": price}), path, "csv")
    events, rejects = io.read_events_and_rejects(spark, path)
    reason = F.substring_index(rejects["reasons"][0], ":", 1)
    return rows.append(events.select(F.lit("kept").alias("reason")), rejects.select(reason.alias("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@check("write_events_csv", over_clicks(EVENT_TOTALS))
def write_events_csv(spark, folder):
    path = new_path(spark, "events-csv")
    io.write_table(clickstream(spark, folder), path, "csv")
    return event_totals(io.read_events(spark, path, "csv"))


@check("read_events_parquet", over_clicks(EVENT_TOTALS))
def read_events_parquet(spark, folder):
    path = new_path(spark, "events-parquet")
    io.write_table(clickstream(spark, folder), path, "parquet", partition_by=["event_type"])
    return event_totals(io.read_events(spark, path, "parquet"))


SESSION_TOTALS = """SELECT "set", COUNT(*) AS n, CAST(SUM(number_of_views) AS BIGINT) AS views,
  ROUND(SUM(total_value_of_views), 2) AS value, CAST(SUM(session_length) AS BIGINT) AS length,
  COUNT(CASE WHEN "newVisitorOrNot" THEN 1 END) AS new_visitors, MIN(event_time) AS first_time FROM marked GROUP BY "set\""""


def session_totals(df):
    return df.groupBy("set").agg(
        F.count(F.lit(1)).alias("n"), F.sum("number_of_views").alias("views"),
        F.round(F.sum("total_value_of_views"), 2).alias("value"), F.sum("session_length").alias("length"),
        F.count_if("newVisitorOrNot").alias("new_visitors"), F.min("event_time").alias("first_time"),
    )


@check("read_sessions_csv", over_split(SESSION_TOTALS))
def read_sessions_csv(spark, folder):
    path = new_path(spark, "sessions-csv")
    io.write_table(split_sessions(spark, folder), path, "csv")
    return session_totals(io.read_sessions(spark, path, "csv"))


@check("write_table_by_set", over_split(SESSION_TOTALS))
def write_table_by_set(spark, folder):
    path = new_path(spark, "sessions-parquet")
    io.write_table(split_sessions(spark, folder), path, "parquet", partition_by=["set"])
    return session_totals(io.read_sessions(spark, path, "parquet"))


@check("bucketed_sessions", over_sessions(f"""SELECT {KEY}, "PurchaseSession", session_length, n, value FROM sess
  JOIN (SELECT {KEY}, COUNT(*) AS n, CAST(SUM(price) AS DOUBLE) AS value FROM labelled GROUP BY ALL) USING ({KEY})"""))
def bucketed_sessions(spark, folder):
    """Events written by bucket and opened again; session table, sums and their join read them without an exchange."""
    path = new_path(spark, "events-bucketed")
    io.write_bucketed(labelled(spark, folder), path)
    events = io.read_bucketed(spark, path)
    sums = events.groupBy(*S.SESSION_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("value"))
    return features.session_table(events).join(sums, S.SESSION_KEY).select(*S.SESSION_KEY, S.LABEL, "session_length", "n", "value")


@check("parse_event_time", over_clicks("SELECT event_id, event_time AS parsed, event_time AS plain FROM clicks"))
def parse_event_time(spark, folder):
    texts = clicks(spark, folder).select("event_id", F.col("event_time").cast("string").alias("t"))
    return texts.select(
        "event_id",
        calendar.parse_event_time(F.concat("t", F.lit(" UTC"))).alias("parsed"),
        calendar.parse_event_time(F.col("t")).alias("plain"),
    )


@check("cast_columns", over_clicks(
    "SELECT event_id, CAST(product_id AS INTEGER) AS product_id, CAST(user_id AS VARCHAR) AS user_id, CAST(price AS DOUBLE) AS price FROM clicks"))
def cast_columns(spark, folder):
    df = clicks(spark, folder).select("event_id", "product_id", "user_id", "price")
    return io.cast_columns(df, {"product_id": "int", "user_id": "string", "price": "double"})


@check("seconds_component", over_sessions(
    f"SELECT {KEY}, session_length // 1000000 AS total_seconds, (session_length // 1000000) % 86400 AS seconds FROM sess"))
def seconds_component(spark, folder):
    us = F.col("session_length")
    return session_rows(spark, folder).select(
        *S.SESSION_KEY, durations.total_seconds(us).alias("total_seconds"), durations.seconds_component(us).alias("seconds"))


# Row filters and projections


@check("not_null", over_clicks("SELECT event_id, user_session FROM raw"))
def not_null(spark, folder):
    return rows.not_null(clicks(spark, folder).select("event_id", "user_session"), "user_session")


@check("only_type", over_clicks("SELECT event_id, product_id FROM clicks WHERE event_type = 'cart'"))
def only_type(spark, folder):
    return rows.only(clicks(spark, folder), "event_type", "cart").select("event_id", "product_id")


@check("drop_event_types", over_clicks("SELECT event_id, event_type FROM clicks WHERE event_type NOT IN ('purchase')"))
def drop_event_types(spark, folder):
    return rows.drop_event_types(clicks(spark, folder), ["purchase"]).select("event_id", "event_type")


@check("sessions_below", over_sessions(
    f"SELECT {KEY}, number_of_total_events_per_session_view_cart AS events FROM sess WHERE number_of_total_events_per_session_view_cart < 5"))
def sessions_below(spark, folder):
    column = "number_of_total_events_per_session_view_cart"
    return rows.sessions_below(session_rows(spark, folder), column, 5).select(*S.SESSION_KEY, F.col(column).alias("events"))


@check("week_of_month", over_clicks("""SELECT event_id, CASE WHEN d <= 7 THEN 1 WHEN d <= 15 THEN 2 WHEN d <= 22 THEN 3 WHEN d <= 31 THEN 4 END AS week
  FROM (SELECT event_id, EXTRACT(day FROM event_time) AS d FROM clicks)"""))
def week_of_month(spark, folder):
    return clicks(spark, folder).select("event_id", calendar.week_of_month(F.dayofmonth("event_time")).alias("week"))


@check("drop_columns", over_clicks("SELECT event_id, event_time, event_type, user_id FROM clicks"))
def drop_columns(spark, folder):
    return rows.drop_columns(clickstream(spark, folder), ["product_id", "category_id", "category_code", "brand", "price", "user_session"])


@check("rename_columns", over_clicks("SELECT event_id, event_type AS kind, user_id AS visitor FROM clicks"))
def rename_columns(spark, folder):
    df = clicks(spark, folder).select("event_id", "event_type", "user_id")
    return rows.rename_columns(df, {"event_type": "kind", "user_id": "visitor"})


@check("select_numeric", over_clicks("SELECT event_id, product_id, category_id, CAST(price AS DOUBLE) AS price, user_id FROM clicks"))
def select_numeric(spark, folder):
    return rows.select_by_type(clickstream(spark, folder), "numeric").withColumn("price", F.col("price").cast("double"))


@check("null_profile", over_clicks("""SELECT * FROM (
  SELECT 'category_code' AS "column", COUNT(*) - COUNT(category_code) AS nulls FROM clicks UNION ALL
  SELECT 'brand', COUNT(*) - COUNT(brand) FROM clicks UNION ALL
  SELECT 'user_session', COUNT(*) - COUNT(user_session) FROM clicks UNION ALL
  SELECT 'category_id', COUNT(*) - COUNT(category_id) FROM clicks UNION ALL
  SELECT 'event_type', COUNT(*) - COUNT(event_type) FROM clicks) WHERE nulls > 0"""))
def null_profile(spark, folder):
    return rows.null_profile(clickstream(spark, folder))


@check("fill_unknown", over_clicks("""SELECT event_id, COALESCE(brand, 'Unknown brand') AS brand,
  COALESCE(category_code, 'Unknown category') AS category_code FROM clicks"""))
def fill_unknown(spark, folder):
    return rows.fill_unknown(clickstream(spark, folder)).select("event_id", "brand", "category_code")


@check("predicate_flags", over_sessions("""SELECT user_id, session, CAST("weekDayOrNot" AS INTEGER) AS is_weekday,
  CAST("newVisitorOrNot" AS INTEGER) AS is_new, CAST(number_of_purchases > 0 AS INTEGER) AS bought FROM sess"""))
def predicate_flags(spark, folder):
    return session_rows(spark, folder).select(
        *S.SESSION_KEY, text.as_int(F.col("weekDayOrNot")).alias("is_weekday"),
        text.as_int(F.col("newVisitorOrNot")).alias("is_new"), text.as_int(F.col("number_of_purchases") > 0).alias("bought"))


# Windows and sequences


@check("sessionize", over_sessions("SELECT event_id, user_id, session FROM numbered"))
def sessionize(spark, folder):
    return numbered(spark, folder).select("event_id", "user_id", "session")


@check("sessionize_30_minutes", over_sessions("SELECT event_id, user_id, session FROM numbered", "30 minutes"))
def sessionize_30_minutes(spark, folder):
    return numbered(spark, folder, "30 minutes").select("event_id", "user_id", "session")


@check("event_gaps", over_sessions(f"""SELECT event_id, COALESCE(date_diff('microsecond', LAG(event_time) OVER ({ORDER}), event_time), 0) AS gap_us FROM kept"""))
def event_gaps(spark, folder):
    return sessions.event_gaps(kept(spark, folder)).select("event_id", "gap_us")


@check("event_gaps_without_purchases", over_sessions(f"""SELECT event_id, COALESCE(date_diff('microsecond', LAG(event_time) OVER ({ORDER}), event_time), 0) AS gap_us
  FROM kept WHERE event_type <> 'purchase'"""))
def event_gaps_without_purchases(spark, folder):
    return sessions.event_gaps(rows.drop_event_types(kept(spark, folder), ["purchase"])).select("event_id", "gap_us")


@check("session_key", over_sessions("SELECT event_id, user_id || '_' || session AS user_session_id_new FROM numbered"))
def session_key(spark, folder):
    return sessions.session_key(numbered(spark, folder)).select("event_id", S.SESSION_TEXT)


@check("renumber_sessions", over_sessions("""SELECT event_id, user_id,
  CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY session) - 1 AS BIGINT) AS session FROM counted WHERE n_view > 0"""))
def renumber_sessions(spark, folder):
    left = sessions.sessions_with(numbered(spark, folder), "view")
    return sessions.renumber_sessions(left).select("event_id", "user_id", "session")


@check("prepared_sessions", over_sessions("SELECT event_id, user_id, session FROM kept"))
def prepared_sessions(spark, folder):
    return kept(spark, folder).select("event_id", "user_id", "session")


@check("prepared_sessions_30_minutes", over_sessions("SELECT event_id, user_id, session FROM kept", "30 minutes"))
def prepared_sessions_30_minutes(spark, folder):
    return kept(spark, folder, "30 minutes").select("event_id", "user_id", "session")


@check("first_event", over_sessions(f"""SELECT {KEY}, event_type, event_time, event_id, product_id FROM numbered
  QUALIFY ROW_NUMBER() OVER ({ORDER}) = 1"""))
def first_event(spark, folder):
    return sessions.first_event(numbered(spark, folder))


@check("dedupe_first_session", over_sessions(f"SELECT {KEY}, event_id, product_id FROM numbered QUALIFY ROW_NUMBER() OVER ({ORDER}) = 1"))
def dedupe_first_session(spark, folder):
    df = numbered(spark, folder).select(*S.SESSION_KEY, "event_time", "event_id", "product_id")
    return rows.dedupe_first(df, S.SESSION_KEY, ["event_time", "event_id"]).drop("event_time")


@check("dedupe_first_product", over_clicks("""SELECT product_id, event_id, CAST(price AS DOUBLE) AS price FROM raw
  QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY event_time, event_id) = 1"""))
def dedupe_first_product(spark, folder):
    df = raw(spark, folder).select("product_id", "event_time", "event_id", F.col("price").cast("double").alias("price"))
    return rows.dedupe_first(df, ["product_id"], ["event_time", "event_id"]).drop("event_time")


@check("event_position", over_sessions(f"SELECT event_id, CAST(ROW_NUMBER() OVER ({ORDER}) - 1 AS INTEGER) AS position FROM kept"))
def event_position(spark, folder):
    return sessions.event_position(kept(spark, folder)).select("event_id", "position")


FACTORIZED = f""",
placed AS (SELECT *, ROW_NUMBER() OVER ({ORDER}) AS pos FROM kept),
firsts AS (SELECT *, MIN(pos) OVER (PARTITION BY {KEY}, product_id) AS first_pos FROM placed)"""


@check("factorize", over_sessions(
    f"SELECT event_id, CAST(DENSE_RANK() OVER (PARTITION BY {KEY} ORDER BY first_pos) - 1 AS INTEGER) AS code FROM firsts", extra=FACTORIZED))
def factorize(spark, folder):
    return sessions.factorize(kept(spark, folder)).select("event_id", "code")


@check("consecutive_pairs", over_sessions(f"""SELECT {KEY}, src, dst, seq FROM (SELECT {KEY}, product_id AS src, LEAD(product_id) OVER ({ORDER}) AS dst,
  CAST(ROW_NUMBER() OVER ({ORDER}) - 1 AS INTEGER) AS seq FROM kept) WHERE dst IS NOT NULL"""))
def consecutive_pairs(spark, folder):
    return sessions.consecutive_pairs(kept(spark, folder), "product_id")


# Whole-session filters


@check("sessions_with_view", over_sessions("SELECT event_id FROM counted WHERE n_view > 0"))
def sessions_with_view(spark, folder):
    return sessions.sessions_with(numbered(spark, folder), "view").select("event_id")


@check("sessions_min_events", over_sessions("SELECT event_id FROM counted WHERE n_vc > 1"))
def sessions_min_events(spark, folder):
    return sessions.sessions_min_events(numbered(spark, folder)).select("event_id")


@check("sessions_max_events", over_sessions("SELECT event_id, session FROM counted WHERE n_all < 101"))
def sessions_max_events(spark, folder):
    return sessions.sessions_max_events(numbered(spark, folder)).select("event_id", "session")


@check("sessions_max_events_tight", over_sessions("SELECT event_id, session FROM counted WHERE n_all <= 6"))
def sessions_max_events_tight(spark, folder):
    return sessions.sessions_max_events(numbered(spark, folder), 6).select("event_id", "session")


@check("sessions_starting_with_view", over_sessions("SELECT event_id FROM labelled"))
def sessions_starting_with_view(spark, folder):
    return sessions.sessions_starting_with(kept(spark, folder), "view").select("event_id")


_COUNTS = "COUNT(*) AS sessions, CAST(COALESCE(SUM(n_all), 0) AS BIGINT) AS events FROM per WHERE"


@check("filter_report", over_sessions(f"""SELECT 0 AS step_no, 'input' AS step, {_COUNTS} TRUE UNION ALL
  SELECT 1, 'required', {_COUNTS} n_view > 0 UNION ALL
  SELECT 2, 'min_events', {_COUNTS} n_view > 0 AND n_vc > 1 UNION ALL
  SELECT 3, 'max_events', {_COUNTS} n_view > 0 AND n_vc > 1 AND n_all < 101""",
  extra=f", per AS (SELECT {KEY}, MAX(n_all) AS n_all, MAX(n_view) AS n_view, MAX(n_vc) AS n_vc FROM counted GROUP BY {KEY})"))
def filter_report(spark, folder):
    return sessions.filter_report(rows.not_null(clicks(spark, folder), "user_session"), GAP)


# Membership joins, order, set operations


@check("semi_sessions", over_sessions(f"SELECT event_id FROM kept WHERE ({KEY}) IN (SELECT ({KEY}) FROM kept WHERE event_type = 'purchase')"))
def semi_sessions(spark, folder):
    df = kept(spark, folder)
    return rows.semi(df, rows.only(df, "event_type", "purchase")).select("event_id")


@check("anti_sessions", over_sessions(f"SELECT event_id FROM kept WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM kept WHERE event_type = 'purchase')"))
def anti_sessions(spark, folder):
    df = kept(spark, folder)
    return rows.anti(df, rows.only(df, "event_type", "purchase")).select("event_id")


@check("ordered_events", over_sessions("SELECT user_id, event_time, event_id FROM kept ORDER BY user_id, event_time, event_id"))
def ordered_events(spark, folder):
    return rows.ordered(kept(spark, folder).select("user_id", "event_time", "event_id"), "user_id", "event_time", "event_id")


@check("shuffle_rows", over_clicks("SELECT event_id, user_id FROM clicks ORDER BY md5('7|' || event_id)"))
def shuffle_rows(spark, folder):
    return rows.shuffle_rows(clicks(spark, folder).select("event_id", "user_id"), "event_id", 7)


@check("append_view_cart", over_sessions("SELECT event_id, event_type FROM kept WHERE event_type IN ('view', 'cart')"))
def append_view_cart(spark, folder):
    df = kept(spark, folder).select("event_id", "event_type")
    return rows.append(rows.only(df, "event_type", "view"), rows.only(df, "event_type", "cart"))


@check("distinct_items", over_sessions(
    f"SELECT {KEY}, {distinct_sql('product_id', 'view')} AS distinct_views FROM kept GROUP BY {KEY}"))
def distinct_items(spark, folder):
    lists = features.per_session(kept(spark, folder), products=features.values_by_type("product_id", "view"))
    return lists.select(*S.SESSION_KEY, F.size(rows.distinct_items(F.col("products"))).cast("bigint").alias("distinct_views"))


# Scalar functions


@check("calendar_parts", over_sessions('SELECT event_id, "day", "month", "weekDay", "hour", "weekDayOrNot", "dayTime" FROM enriched'))
def calendar_parts(spark, folder):
    return kept(spark, folder).select("event_id", *[c.alias(n) for n, c in calendar.calendar_parts(F.col("event_time")).items()])


@check("day_floor", over_clicks("SELECT event_id, CAST(date_trunc('day', event_time) AS TIMESTAMP) AS day FROM clicks"))
def day_floor(spark, folder):
    return clicks(spark, folder).select("event_id", calendar.day_floor(F.col("event_time")).alias("day"))


@check("month_and_day_names", over_clicks("""SELECT event_id, monthname(event_time) AS month_name, dayname(event_time) AS day_name FROM clicks"""))
def month_and_day_names(spark, folder):
    t = F.col("event_time")
    return clicks(spark, folder).select(
        "event_id", calendar.month_name(F.month(t)).alias("month_name"), calendar.day_name(calendar.weekday(t)).alias("day_name"))


@check("category_levels", over_clicks("""SELECT event_id, string_split(category_code, '.')[1] AS "parentProductCategory",
  string_split(category_code, '.')[2] AS "secondaryProductCategory", string_split(category_code, '.')[3] AS "thirdProductCategory" FROM clicks"""))
def category_levels(spark, folder):
    return clickstream(spark, folder).select("event_id", *[c.alias(n) for n, c in text.category_levels(F.col("category_code")).items()])


@check("strip_copy_suffix", over_sessions(f"SELECT {KEY}, user_id || '_' || session || 'D1' AS copy_id, user_id || '_' || session AS original_id FROM sess"))
def strip_copy_suffix(spark, folder):
    copy_id = F.concat(S.SESSION_TEXT, text.copy_suffix(F.lit(2)))
    return session_rows(spark, folder).select(
        *S.SESSION_KEY, copy_id.alias("copy_id"), text.strip_copy_suffix(copy_id).alias("original_id"))


@check("durations", over_sessions(f"SELECT {KEY}, date_diff('microsecond', MIN(event_time), MAX(event_time)) AS us FROM numbered GROUP BY {KEY}"))
def duration_between(spark, folder):
    spans = features.per_session(numbered(spark, folder), a=features.first_time(), b=features.last_time())
    return spans.select(*S.SESSION_KEY, durations.duration_us(F.col("a"), F.col("b")).alias("us"))


@check("timedelta_text", over_sessions(f"SELECT {KEY}, session_length AS us FROM sess"))
def timedelta_text(spark, folder):
    us = F.col("session_length")
    days, rest = F.floor(us / 86_400_000_000), F.pmod(us, F.lit(86_400_000_000))
    clock = F.format_string(
        "%d days %02d:%02d:%02d.%06d", days, F.floor(rest / 3_600_000_000), F.floor(rest / 60_000_000) % 60,
        F.floor(rest / 1_000_000) % 60, rest % 1_000_000)
    return session_rows(spark, folder).select(*S.SESSION_KEY, durations.parse_timedelta(clock).alias("us"))


@check("oversample_rate", over_clicks("""SELECT user_id, ratio,
  COALESCE(CAST(TRUNC(ROUND_EVEN(1.0e0 / ratio, 0) / 8) AS INTEGER), 0) AS rate FROM (
  SELECT user_id, CAST(COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) / (10 * NULLIF(COUNT(*), 0)) AS ratio FROM clicks GROUP BY user_id)
  WHERE ratio > 0"""))
def oversample_rate(spark, folder):
    ratio = F.count_if(F.col("event_type") == "purchase").cast("double") / (10 * F.count(F.lit(1)))
    per = clicks(spark, folder).groupBy("user_id").agg(ratio.alias("ratio")).filter("ratio > 0")
    return per.select("user_id", "ratio", text.oversample_rate(F.col("ratio")).alias("rate"))
