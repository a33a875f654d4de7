"""Registry of queries with their SQL twins, and the SQL building blocks they share."""

from clicktrail import schemas as S
from clicktrail.functions.calendar import DAY_NAMES, DAY_TIMES, MONTH_NAMES
from clicktrail.operators import features, rows, sampling, sessions
from clicktrail.sources.testdata import clicks, clickstream, with_products
from clicktrail.spark import materialize

GAP = "12 hours"  # random users make 30-minute sessions short, see FIXTURES.md

QUERIES, ORACLES = {}, {}


def check(name, sql=None):
    """Register a query; ``sql`` is its DuckDB twin, left out where SQL cannot say it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# Spark side


def raw(spark, folder):
    return rows.not_null(clickstream(spark, folder), "user_session")


def numbered(spark, folder, gap=GAP):
    return sessions.sessionize(raw(spark, folder), gap)


def kept(spark, folder, gap=GAP):
    """Filtered and renumbered sessions; products are looked up for kept events only."""
    slim = rows.not_null(clicks(spark, folder), "user_session")
    return with_products(sessions.prepare_sessions(slim, gap), folder)


def enriched(spark, folder, gap=GAP):
    return features.enrich(kept(spark, folder, gap))


def labelled(spark, folder, gap=GAP):
    return features.labelled_events(enriched(spark, folder, gap))


def session_rows(spark, folder, gap=GAP):
    return features.session_table(labelled(spark, folder, gap))


def _marking(table):
    n = table.count()  # of a written table
    return sampling.stratified_split(table, train_n=n * 2 // 5, test_n=n // 5)


def split_tables(spark, folder):
    """Events and sessions with ``set``: two fifths train, one fifth test."""
    events = materialize(labelled(spark, folder))
    table = materialize(features.session_table(events))
    split = _marking(table)
    return split.assign(events), split.assign(table)


def split_sessions(spark, folder):
    """The sessions alone; events are not written."""
    table = materialize(session_rows(spark, folder))
    return _marking(table).assign(table)


def train_sessions(spark, folder):
    return rows.only(split_sessions(spark, folder), "set", "train")


def train_events(spark, folder):
    return rows.only(split_tables(spark, folder)[0], "set", "train")


# SQL side


def _texts(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


DAY_TIME_SQL = f"{_texts(DAY_TIMES)}[CAST(EXTRACT(hour FROM event_time) AS INTEGER) // 4 + 1]"
MONTH_SQL, DAY_SQL = _texts(MONTH_NAMES), _texts(DAY_NAMES)

CLICKS = """
c AS (
  SELECT event_id, ts AS event_time,
         CASE event_type WHEN 'click' THEN 'cart' ELSE event_type END AS event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
         user_id, CAST(value AS DECIMAL(24,6)) AS price,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS user_session
  FROM events),
clicks AS (
  SELECT c.*, CAST(p.p_size AS BIGINT) AS category_id,
         CASE WHEN p.p_partkey % 7 = 0 THEN NULL
              ELSE lower(concat_ws('.', p.p_type, replace(p.p_name, ' ', '.'))) END AS category_code,
         CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE p.p_brand END AS brand
  FROM c LEFT JOIN part p ON c.product_id = p.p_partkey),
raw AS (SELECT * FROM clicks WHERE user_session IS NOT NULL)"""

USER_ORDER = "PARTITION BY user_id ORDER BY event_time, event_id"
KEY = "user_id, session"
ORDER = f"PARTITION BY {KEY} ORDER BY event_time, event_id"


def session_ctes(gap=GAP):
    return f"""{CLICKS},
cut AS (
  SELECT *, CASE WHEN event_time - LAG(event_time) OVER ({USER_ORDER}) > INTERVAL '{gap}' THEN 1 ELSE 0 END AS is_cut
  FROM raw),
numbered AS (
  SELECT * EXCLUDE (is_cut),
         CAST(SUM(is_cut) OVER ({USER_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM cut),
counted AS (
  SELECT *, COUNT(*) OVER s AS n_all,
         SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER s AS n_view,
         SUM(CASE WHEN event_type IN ('view', 'cart') THEN 1 ELSE 0 END) OVER s AS n_vc
  FROM numbered WINDOW s AS (PARTITION BY {KEY})),
kept AS (
  SELECT * EXCLUDE (n_all, n_view, n_vc, session),
         CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY session) - 1 AS BIGINT) AS session
  FROM counted WHERE n_view > 0 AND n_vc > 1 AND n_all < 101),
enriched AS (
  SELECT event_time, event_type, product_id, category_id, user_id, price, user_session, event_id, session,
         user_id || '_' || session AS user_session_id_new,
         COALESCE(category_code, 'Unknown category') AS category_code,
         COALESCE(brand, 'Unknown brand') AS brand,
         CAST(EXTRACT(day FROM event_time) AS INTEGER) AS "day",
         CAST(EXTRACT(month FROM event_time) AS INTEGER) AS "month",
         CAST(EXTRACT(isodow FROM event_time) - 1 AS INTEGER) AS "weekDay",
         CAST(EXTRACT(hour FROM event_time) AS INTEGER) AS "hour",
         EXTRACT(isodow FROM event_time) < 6 AS "weekDayOrNot",
         {DAY_TIME_SQL} AS "dayTime",
         COALESCE(string_split(category_code, '.')[1], 'Unknown category') AS "parentProductCategory",
         COALESCE(string_split(category_code, '.')[2], 'Unknown category') AS "secondaryProductCategory",
         COALESCE(string_split(category_code, '.')[3], 'Unknown category') AS "thirdProductCategory",
         session = 0 AS "newVisitorOrNot"
  FROM kept),
labelled AS (
  SELECT * EXCLUDE (first_type) FROM (
    SELECT *, FIRST_VALUE(event_type) OVER ({ORDER}) AS first_type,
           MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY}) AS "PurchaseSession"
    FROM enriched) WHERE first_type = 'view'),
{table_cte('sess', 'labelled')}"""


def distinct_sql(column, event_type):
    return f"COUNT(DISTINCT CASE WHEN event_type = '{event_type}' THEN {column} END)"


def total_sql(event_type):
    return f"CAST(COALESCE(SUM(CASE WHEN event_type = '{event_type}' THEN price END), 0) AS DOUBLE)"


def count_sql(event_type):
    return f"COUNT(CASE WHEN event_type = '{event_type}' THEN 1 END)"


def average_sql(event_type):
    return f"ROUND(COALESCE({total_sql(event_type)} / NULLIF({count_sql(event_type)}, 0), 0), 6)"


_LEVELS = list(zip(("first", "second", "third"), [f'"{c}"' for c in S.CATEGORY_LEVELS]))

FEATURE_SQL = {
    "number_of_views": count_sql("view"),
    "number_of_carts": count_sql("cart"),
    "number_of_purchases": count_sql("purchase"),
    "number_of_total_events_per_session_view_cart": "COUNT(CASE WHEN event_type IN ('view', 'cart') THEN 1 END)",
    "total_value_of_views": total_sql("view"),
    "total_value_of_carts": total_sql("cart"),
    "number_of_unique_views": distinct_sql("product_id", "view"),
    "number_of_unique_carts": distinct_sql("product_id", "cart"),
    **{f"number_of_unique_views_{w}_category_level": distinct_sql(c, "view") for w, c in _LEVELS},
    **{f"number_of_unique_carts_{w}_category_level": distinct_sql(c, "cart") for w, c in _LEVELS},
    "session_length": "date_diff('microsecond', MIN(event_time), MAX(event_time))",
    "max_time_between_two_events": "MAX(gap)",
    "average_value_of_views": average_sql("view"),
    "average_value_of_carts": average_sql("cart"),
}


def feature_list(*names):
    return ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names)


def table_cte(name, source):
    first = ", ".join(
        f'MIN_BY("{c}", pos) AS "{c}"' for c in S.FIRST_EVENT_ATTRIBUTES
    )
    return f"""{name} AS (
  SELECT {KEY}, {first}, {feature_list(*FEATURE_SQL)},
         MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS "PurchaseSession"
  FROM (SELECT *, ROW_NUMBER() OVER ({ORDER}) AS pos,
               COALESCE(date_diff('microsecond', LAG(event_time) OVER ({ORDER}), event_time), 0) AS gap
        FROM {source}) GROUP BY {KEY})"""


def quota_ctes(prefix, counts, size):
    """Largest-remainder shares of ``size`` over ``counts(label, n)``: ``{prefix}(label, n, q)``."""
    return f"""{prefix}_b AS (
  SELECT label, n, t, (n * t) // total AS base, (n * t) % total AS rem
  FROM (SELECT label, n, CAST({size} AS BIGINT) AS t, CAST(SUM(n) OVER () AS BIGINT) AS total FROM {counts})),
{prefix} AS (
  SELECT label, n, CAST(base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, label) <= t - SUM(base) OVER ()
                                    THEN 1 ELSE 0 END AS BIGINT) AS q FROM {prefix}_b)"""


DIGEST = "md5('42|' || user_id || '_' || session)"


def split_ctes():
    """``marked`` is the session table with ``set``, ``marked_events`` the events with it."""
    return f"""{session_ctes()},
classes AS (SELECT "PurchaseSession" AS label, COUNT(*) AS n FROM sess GROUP BY 1),
sizes AS (SELECT CAST(SUM(n) AS BIGINT) * 2 // 5 AS tr, CAST(SUM(n) AS BIGINT) // 5 AS te FROM classes),
{quota_ctes('q_train', 'classes', '(SELECT tr FROM sizes)')},
rest AS (SELECT label, n - q AS n FROM q_train),
{quota_ctes('q_test', 'rest', '(SELECT te FROM sizes)')},
marked AS (
  SELECT s.* EXCLUDE (rk), CASE WHEN rk <= a.q THEN 'train' WHEN rk <= a.q + b.q THEN 'test' END AS "set"
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "PurchaseSession" ORDER BY {DIGEST}) AS rk FROM sess) s
  JOIN q_train a ON s."PurchaseSession" = a.label JOIN q_test b ON s."PurchaseSession" = b.label),
marked_events AS (SELECT e.*, m."set" FROM labelled e JOIN marked m USING ({KEY})),
train AS (SELECT * FROM marked WHERE "set" = 'train'),
train_events AS (SELECT * FROM marked_events WHERE "set" = 'train')"""


def over_clicks(select):
    return f"WITH {CLICKS}\n{select}"


def over_sessions(select, gap=GAP, extra=""):
    return f"WITH {session_ctes(gap)}{extra}\n{select}"


def over_split(select, extra=""):
    return f"WITH {split_ctes()}{extra}\n{select}"
