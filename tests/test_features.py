import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.functions import calendar, durations, text
from clicktrail.operators import eda, features, rows
from clicktrail.sources import events as io
from clicktrail.spark import new_path

from tests.test_sessions import at


def test_category_levels(spark):
    codes = [None, "a", "a.b", "a.b.c", "a.b.c.d", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, category_code string")
    got = df.select("id", *[c.alias(n) for n, c in text.category_levels(F.col("category_code")).items()]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [
        (None, None, None), ("a", None, None), ("a", "b", None), ("a", "b", "c"), ("a", "b", "c"), ("", None, None)]
    filled = rows.fill_unknown(df.withColumns(text.category_levels(F.col("category_code")))).orderBy("id").first()
    assert filled["category_code"] == filled["thirdProductCategory"] == "Unknown category"


@pytest.mark.parametrize("hour,name", [(0, "Late Night"), (3, "Late Night"), (4, "Early Morning"), (7, "Early Morning"),
                                       (8, "Morning"), (15, "Noon"), (16, "Evening"), (23, "Night")])
def test_day_time(spark, hour, name):
    df = spark.sql(f"SELECT timestamp_ntz'2020-02-29 {hour:02}:59:59' AS t")
    assert df.select(calendar.day_time(F.col("t"))).first()[0] == name


def test_week_bands_and_weekdays(spark):
    days = [1, 7, 8, 15, 16, 22, 23, 31]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    assert [r[0] for r in df.select(calendar.week_of_month(F.col("d"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    sat = spark.sql("SELECT timestamp_ntz'2020-02-29 10:00:00' AS t")
    row = sat.select(*[c.alias(n) for n, c in calendar.calendar_parts(F.col("t")).items()]).first()
    assert (row.weekDay, row.weekDayOrNot, row.day, row.month) == (5, False, 29, 2)
    names = sat.select(calendar.month_name(F.lit(12)), calendar.day_name(F.lit(0))).first()
    assert tuple(names) == ("December", "Monday")


def test_durations(spark):
    df = spark.createDataFrame([("1 days 00:00:05.25",), ("0 days 00:30:00",), ("2 days",), ("x",)], "t string")
    us = durations.parse_timedelta(F.col("t"))
    got = df.select(us, durations.total_seconds(us), durations.seconds_component(us)).collect()
    assert [tuple(r) for r in got] == [
        (86_405_250_000, 86405, 5), (1_800_000_000, 1800, 1800), (172_800_000_000, 172800, 0), (None, None, None)]


def test_event_time_texts(spark):
    df = spark.createDataFrame([("2019-10-01 00:00:00 UTC",), ("2019-10-01 00:00:00.5",), ("nonsense",), (None,)], "t string")
    got = [r[0] for r in df.select(calendar.parse_event_time(F.col("t"))).collect()]
    assert got == [datetime(2019, 10, 1), datetime(2019, 10, 1, 0, 0, 0, 500000), None, None]


def test_oversample_rate(spark):
    ratios = [None, 0.01, 0.05, 0.5, 1 / 20, 2.0]
    df = spark.createDataFrame([(r,) for r in ratios], "r double")
    expected = [0 if not r else max(0, int(round(1 / r) / 8)) for r in ratios]
    assert [r[0] for r in df.select(text.oversample_rate(F.col("r"))).collect()] == expected


def test_session_table(events):
    df = events([
        (1, at(0), "view", 1, "10.00", "a.b.c", "x"), (1, at(60), "view", 1, "10.00", "a.b.c", "x"),
        (1, at(100), "cart", 2, "3.50", "a.d", None), (1, at(700), "purchase", 2, "3.50", "a.d", None),
        (2, at(0), "view", 1, "1.00", None), (2, at(10), "view", 3, "2.00", "z"),
    ]).withColumn("session", F.lit(0))
    one, two = features.session_table(features.enrich(df)).orderBy("user_id").collect()
    assert (one.number_of_views, one.number_of_carts, one.number_of_purchases, one.PurchaseSession) == (2, 1, 1, 1)
    assert (one.number_of_unique_views, one.number_of_unique_views_third_category_level) == (1, 1)
    assert (one.total_value_of_views, one.average_value_of_carts) == (20.0, 3.5)
    assert (one.session_length, one.max_time_between_two_events) == (700_000_000, 600_000_000)
    assert (two.number_of_carts, two.total_value_of_carts, two.average_value_of_carts, two.PurchaseSession) == (0, 0.0, 0.0, 0)
    assert two.number_of_unique_views_second_category_level == 1  # both unknown
    assert two.number_of_unique_views_first_category_level == 2


def test_session_table_conserves_events(events):
    df = events([(u, at(i), t) for u in range(4) for i, t in enumerate(["view", "cart", "view", "purchase"])]).withColumn("session", F.lit(0))
    table = features.session_table(features.enrich(df))
    total = table.agg(F.sum(F.col("number_of_total_events_per_session_view_cart") + F.col("number_of_purchases"))).first()[0]
    assert total == df.count()


def test_statistics_match_by_hand(events):
    df = events([(1, at(0), "view"), (2, at(0), "view"), (2, at(5), "purchase")]).withColumns({"session": F.lit(0), "set": F.lit("train")})
    table = df.select("user_id", "session", "set").distinct()
    r = features.train_statistics(df, table).first()
    assert (r.events, r.sessions, r.users, r.single_event_sessions, r.single_event_percent) == (3, 2, 2, 1, 50.0)
    assert (r.events_per_session, r.purchase_sessions, r.purchase_percent, r.session_table_rows) == (1.5, 1, 50.0, 2)


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5, None), (2.0, 4.0, 5, None), (3.0, None, 5, 1.0)], "a double, b double, c int, d double")
    got = {(r.a, r.b): r.r for r in eda.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    assert got[("a", "b")] == pytest.approx(1.0) and got[("b", "b")] == pytest.approx(1.0)
    assert got[("a", "c")] is None and got[("b", "d")] is None


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 10]], "v double")
    grid = eda.kde(df, "v", -30, 40, 400).orderBy("x").collect()
    step = grid[1].x - grid[0].x
    assert sum(r.density for r in grid) * step == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("bins", [1 << 10, 1 << 16])
def test_density_from_cells_is_within_its_bound(spark, bins):
    """Against the kernel over all values, heavy tails far beyond the range among them."""
    rng = random.Random(4)
    values = [rng.gauss(40, 15) for _ in range(1500)] + [rng.paretovariate(1.1) * 50 for _ in range(500)] + [-3.0, 0.0, 100.0, 1e7]
    df = spark.createDataFrame([(v,) for v in values[:-1]], "v double")
    values = values[:-1]
    cells = eda.kde_cells(df, "v", 0.0, 100.0, bins).collect()
    assert len(cells) <= min(len(values), 8 * bins) and sum(r.n for r in cells) == len(values)
    h = statistics.stdev(values) * len(values) ** -0.2
    peak = 1 / (h * math.sqrt(2 * math.pi))
    for r in eda.kde(df, "v", 0.0, 100.0, 50, bins).collect():
        exact = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / len(values) * peak
        assert abs(r.density - exact) <= peak * ((100 / bins / h) ** 2 / 8 + 1e-6)


def test_density_rows_are_bounded_by_cells(spark):
    df = spark.range(200_000).selectExpr("id / 1999.0 AS v")
    assert eda.kde_cells(df, "v", 0.0, 100.0, 512).count() <= 513 + 1


def test_correlation_of_hundreds_of_columns(spark):
    """Names with quotes, values far from zero, missing ones; one pass."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(400, 30))
    x = z @ rng.normal(size=(30, 300)) + 1e7
    x[:, 5] = 3.5
    names = [f"it's `{i}`" for i in range(300)]
    rows = [[None if (i + j) % 50 == 0 and j > 290 else float(v) for j, v in enumerate(row)] for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join("`" + n.replace("`", "``") + "` double" for n in names))
    got = {(r.a, r.b): r.r for r in eda.correlation_matrix(df, names).collect()}
    assert len(got) == 300 * 300
    for i, j in [(0, 1), (7, 299), (10, 10), (150, 20), (295, 298)]:
        keep = [k for k in range(400) if rows[k][i] is not None and rows[k][j] is not None]
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[keep, i], x[keep, j])[0, 1], abs=1e-7) == got[names[j], names[i]]
    assert got[names[5], names[0]] is None and got[names[5], names[5]] is None


def test_rows_in_are_rows_out_and_rejects(spark, tmp_path):
    path = str(tmp_path / "e.csv")
    good = "2020-01-01 00:00:0{} UTC,view,1,2,a.b,x,{},1,s,{}"
    with open(path, "w") as f:
        f.write("event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session,event_id\n")
        f.write("\n".join([good.format(1, "1.25", 1), good.format(2, "1.2345670", 2), good.format(3, "1.23456789", 3), good.format(4, "abc", 4),
                           "soon,view,one,2,a.b,x,1.0,1,s,5", good.format(6, "", 6)]) + "\n")
    events, rejects = io.read_events_and_rejects(spark, path)
    assert events.schema.fieldNames() == io.read_events(spark, path).schema.fieldNames()
    assert sorted(r.event_id for r in events.collect()) == [1, 2, 6]
    assert {r.event_id: r.reasons for r in rejects.collect()} == {
        "3": ["more than 6 places in price: 1.23456789"], "4": ["unreadable price: abc"], "5": ["unreadable event_time: soon", "unreadable product_id: one"]}
    assert [r.price for r in rejects.collect() if r.event_id == "3"] == ["1.23456789"]
    with pytest.raises(Exception, match="more than 6 places"):
        io.read_events(spark, path).filter("event_id = 3").collect()


def test_sketches_of_days_merge(spark):
    from clicktrail.operators import features

    df = spark.range(60_000).selectExpr("id % 20000 AS user_id", "id % 7 AS session", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(id % 10 AS INT)) AS event_time")
    df = df.union(df.limit(3).selectExpr("CAST(NULL AS LONG)", "session", "event_time"))
    stored = features.distinct_sketches(df, users=["user_id"], sessions=["user_id", "session"]).cache()
    assert stored.count() == 10
    for first, last in (("2020-01-01", "2020-01-10"), ("2020-01-03", "2020-01-04"), (None, None), ("2021-01-01", None)):
        part = df.filter(F.to_date("event_time").between(first or "2000-01-01", last or "2100-01-01")).dropna()
        got = features.distinct_from_sketches(stored, first, last).first()
        assert got.users == pytest.approx(part.select("user_id").distinct().count(), rel=0.03)
        assert got.sessions == pytest.approx(part.select("user_id", "session").distinct().count(), rel=0.03)


def test_csv_keeps_names_and_microseconds(spark, events):
    df = events([(1, str(datetime(2020, 1, 1) + timedelta(microseconds=7)), "view", 3, "1.25", None, "ü")])
    path = new_path(spark, "round-trip")
    io.write_table(df.select(*reversed(df.columns)), path, "csv")
    back = io.read_events(spark, path).first()
    assert back.event_time == datetime(2020, 1, 1, 0, 0, 0, 7)
    assert (back.category_code, back.brand, float(back.price), back.product_id) == (None, "ü", 1.25, 3)


def test_event_id_from_content(spark, events):
    df = events([(1, at(0), "view"), (1, at(0), "cart"), (1, at(0), "view")]).drop("event_id")
    ids = [r.event_id for r in io.with_event_id(df).collect()]
    assert ids[0] == ids[2] != ids[1]


def test_null_profile_and_types(spark):
    df = spark.createDataFrame([(1, None, True), (2, "a", None)], "a int, b string, c boolean")
    assert {(r.column, r.nulls) for r in rows.null_profile(df).collect()} == {("b", 1), ("c", 1)}
    assert rows.columns_by_type(df, "numeric") == ["a"]


def test_session_file_with_duration_texts(spark):
    path = new_path(spark, "texts")
    df = spark.createDataFrame([("1", "0 days 00:12:30", "5"), ("2", "1 days 00:00:01", "6")], "user_id string, session_length string, max_time_between_two_events string")
    io.write_table(df, path, "csv")
    got = io.read_sessions(spark, path).orderBy("user_id").collect()
    assert [(r.user_id, r.session_length, r.max_time_between_two_events) for r in got] == [(1, 750_000_000, 5), (2, 86_401_000_000, 6)]


def test_durations_without_some_types(spark, events):
    """First, last and inner events of the type are passed over; with nothing left durations are 0; events without a type count."""
    minute = lambda m: f"2020-01-01 10:{m:02}:00"
    df = events([
        (1, minute(0), "purchase"), (1, minute(5), "view"), (1, minute(6), "purchase"), (1, minute(9), "cart"), (1, minute(20), "purchase"),
        (2, minute(0), "purchase"), (2, minute(7), "purchase"),
        (3, minute(0), None), (3, minute(2), "view"),
    ]).withColumn("session", F.lit(0).cast("bigint"))
    enriched = features.enrich(df)
    got = {r["user_id"]: (r["session_length"] // 60_000_000, r["max_time_between_two_events"] // 60_000_000)
           for r in features.session_table(enriched, ["purchase"]).collect()}
    assert got == {1: (4, 4), 2: (0, 0), 3: (2, 2)}
    assert {r["user_id"]: r[2] // 60_000_000 for r in features.max_gap(df, ["purchase"]).collect()} == {1: 4, 2: 0, 3: 2}
    whole = {r["user_id"]: (r["session_length"] // 60_000_000, r["max_time_between_two_events"] // 60_000_000) for r in features.session_table(enriched).collect()}
    assert whole == {1: (20, 11), 2: (7, 7), 3: (2, 2)}
