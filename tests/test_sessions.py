from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clicktrail.operators import features, rows, sessions

T0 = "2020-01-01 00:00:00"


def at(seconds, micros=0):
    return str(datetime(2020, 1, 1) + timedelta(seconds=seconds, microseconds=micros))


def by_id(df, column):
    return [r[column] for r in df.select("event_id", column).orderBy("event_id").collect()]


@pytest.mark.parametrize("shuffle", [False, True])
def test_gap_is_strict(events, shuffle):
    times = [(0, 0), (1799, 0), (3599, 0), (5399, 1), (5399, 1), (12000, 0)]
    df = events([(1, at(s, us), "view") for s, us in times], shuffle)
    assert by_id(sessions.sessionize(df), "session") == [0, 0, 0, 1, 1, 2]


@pytest.mark.parametrize("gap", ["1 minute", "7 minutes", "30 minutes", "12 hours"])
def test_cells_equal_a_pass_over_events(events, gap):
    """The cell form gives the numbers that comparing neighbours gives."""
    seconds = [(u, (i * i * 977 + u * 131 + i * 61) % 90000) for u in range(5) for i in range(60)]
    df = events([(u, at(s, (s * 7919) % 1000000), "view") for u, s in seconds])
    got = {(r.user_id, r.event_id): r.session for r in sessions.sessionize(df, gap).collect()}
    limit, expected = timedelta(microseconds=sessions.micros_of(gap)), {}
    rows_ = sorted(df.collect(), key=lambda r: (r.user_id, r.event_time, r.event_id))
    last = None
    for r in rows_:
        if last is None or last[0] != r.user_id:
            number = 0
        elif r.event_time - last[1] > limit:
            number += 1
        expected[(r.user_id, r.event_id)] = number
        last = (r.user_id, r.event_time)
    assert got == expected


def test_rows_without_time_or_user_are_kept(events):
    df = events([(1, T0, "view"), (None, T0, "view"), (1, None, "view")])
    assert by_id(sessions.sessionize(df), "session") == [0, None, None]


def test_sessions_without_view_go(events):
    rows_ = [(1, at(0), "cart"), (1, at(1), "purchase"), (1, at(9000), "view"), (1, at(9001), "cart"), (2, at(0), "error")]
    kept = sessions.prepare_sessions(events(rows_))
    assert [(r.event_id, r.session) for r in kept.orderBy("event_id").collect()] == [(2, 0), (3, 0)]


@pytest.mark.parametrize("n,stays", [(1, False), (2, True), (100, True), (101, False)])
def test_size_limits(events, n, stays):
    kept = sessions.prepare_sessions(events([(1, at(i), "view") for i in range(n)]))
    assert kept.count() == (n if stays else 0)


def test_other_types_count_towards_the_maximum_only(events):
    rows_ = [(1, at(0), "view"), (1, at(1), "signup")] + [(2, at(i), "view" if i < 50 else "error") for i in range(101)]
    assert sessions.prepare_sessions(events(rows_)).count() == 0


def test_renumbering_equals_cutting_again(events):
    pattern = [(u, i * 2400 + j * 60, "view" if (u * 7 + i * 5 + j) % 3 else "cart")
               for u in range(4) for i in range(20) for j in range(1 + (i * u) % 3)]
    df = events([(u, at(s), t) for u, s, t in pattern])
    kept = sessions.prepare_sessions(df)
    again = sessions.sessionize(kept.drop("session"))
    assert kept.count() > 0
    assert by_id(kept, "session") == by_id(again, "session")
    apart = sessions.sessions_with(sessions.sessionize(df), "view")
    apart = sessions.sessions_max_events(sessions.sessions_min_events(apart))
    assert by_id(sessions.renumber_sessions(apart), "session") == by_id(kept, "session")


def test_numbers_are_dense(events):
    df = events([(u, at(i * 4000 * (1 + u % 2)), "view" if i % 3 else "cart") for u in range(3) for i in range(30)])
    kept = sessions.prepare_sessions(df, "2 hours")
    spans = kept.groupBy("user_id").agg(F.count_distinct("session").alias("n"), F.max("session").alias("m"))
    assert all(r.n == r.m + 1 for r in spans.collect())


def test_filter_report_ends_at_what_is_kept(events):
    df = events([(u, at(i * 1000), t) for u in range(5) for i, t in enumerate(["view", "cart", "error", "view"][u % 3:])])
    last = sessions.filter_report(df).filter("step = 'max_events'").first()
    kept = sessions.prepare_sessions(df)
    assert (last.events, last.sessions) == (kept.count(), kept.select("user_id", "session").distinct().count())


def test_first_event_and_start_filter(events):
    df = events([(1, at(5), "view"), (1, at(3), "cart"), (2, at(0), "view"), (2, at(0), "cart")]).withColumn("session", F.lit(0))
    first = {r.user_id: r.event_type for r in sessions.first_event(df).collect()}
    assert first == {1: "cart", 2: "view"}
    assert {r.user_id for r in sessions.sessions_starting_with(df).collect()} == {2}
    assert {r.user_id for r in features.labelled_events(df).collect()} == {2}


def test_gap_position_and_code(events):
    df = events([(1, at(s), "view", p) for s, p in [(0, 5), (10, 5), (15, 3), (40, 5), (41, 9)]]).withColumn("session", F.lit(0))
    assert by_id(sessions.event_gaps(df), "gap_us") == [0, 10_000_000, 5_000_000, 25_000_000, 1_000_000]
    assert by_id(sessions.event_position(df), "position") == [0, 1, 2, 3, 4]
    assert by_id(sessions.factorize(df), "code") == [0, 0, 1, 0, 2]
    pairs = sessions.consecutive_pairs(df, "product_id").orderBy("seq").collect()
    assert [(r.src, r.dst) for r in pairs] == [(5, 5), (5, 3), (3, 5), (5, 9)]


@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_partitioning_does_not_matter(spark, events, partitions):
    df = events([(u, at(i * 1500 + u), "view" if i % 2 else "cart", i % 4) for u in range(6) for i in range(12)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        table = features.session_table(features.enrich(sessions.prepare_sessions(df.repartition(3))))
        got = sorted(map(tuple, table.select("user_id", "session", "number_of_views", "session_length").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == [(u, 0, 6, 16_500_000_000) for u in range(6)]


def test_robot_user_and_session(spark):
    """One user holds a third of all events, all within one session: dropped whole, others untouched."""
    robot = spark.range(60_000).selectExpr("id AS event_id", "0L AS user_id", "id * 20000 AS us")
    people = spark.range(120_000).selectExpr(
        "id + 60000 AS event_id", "1 + id % 30000 AS user_id", "(id DIV 30000) * 60000000 AS us")
    df = robot.union(people).selectExpr(
        "event_id", "user_id", "timestampadd(MICROSECOND, us, timestamp_ntz'2020-01-01') AS event_time", "'view' AS event_type")
    kept = sessions.prepare_sessions(df)
    assert kept.count() == 120_000
    assert kept.filter("user_id = 0 OR session <> 0").count() == 0
    cells = sessions.session_cells(df).filter("user_id = 0").count()
    assert cells == 1  # 20 minutes of events


def test_robot_user_with_many_sessions(spark):
    """A hot user spread over many small sessions keeps all of them."""
    df = spark.range(30_000).selectExpr(
        "id AS event_id", "IF(id % 3 = 0, 0L, id) AS user_id",
        "timestampadd(SECOND, (id DIV 30) * 3600 + id % 30, timestamp_ntz'2020-01-01') AS event_time", "'view' AS event_type")
    kept = sessions.prepare_sessions(df)
    hot = kept.filter("user_id = 0")
    assert hot.count() == 10_000
    assert hot.select("session").distinct().count() == 1_000


def test_dedupe_first(events):
    df = events([(1, at(5), "view", 1, "5.00"), (1, at(3), "view", 1, "3.00"), (1, at(9), "view", 2, "9.00")])
    first = rows.dedupe_first(df, ["product_id"], ["event_time", "event_id"])
    assert {r.product_id: float(r.price) for r in first.collect()} == {1: 3.0, 2: 9.0}
