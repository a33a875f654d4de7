"""What the physical plans must look like."""

import os
import re

import pytest

from checks import base, registry  # noqa: F401
from clicktrail.operators import features, graphs, sessions, smote
from clicktrail.operators.rows import semi
from clicktrail.plans import flows
from clicktrail.sources import events as io
from clicktrail.sources.testdata import clickstream
from clicktrail.spark import materialize, new_path

FOLDER = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    text = plan(base.QUERIES["drop_event_types"](spark, FOLDER))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_cells_are_aggregated_before_the_shuffle(spark):
    text = plan(sessions.session_cells(base.clicks(spark, FOLDER), base.GAP))
    lines = text.splitlines()
    first_scan = next(i for i, l in enumerate(lines) if "FileScan" in l)
    last_exchange = max(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    between = lines[last_exchange:first_scan]
    assert any("partial_min" in l for l in between)


def test_events_are_shuffled_twice(spark):
    """Once for the cell lookup, once for the session key; the session table adds no third exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sessions.prepare_sessions(base.clicks(spark, FOLDER), base.GAP)
        by_session = len(re.findall(r"Exchange hashpartitioning\(user_id#\w+, session#\w+", plan(kept)))
        whole = features.session_table(features.labelled_events(features.enrich(
            kept.selectExpr("*", "'a.b' AS category_code", "'x' AS brand"))))
        text = plan(whole)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert by_session == 0
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\w+, session#\w+", text)) == 1
    assert "Expand" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_rows_in_the_hot_path(spark):
    for name in ("session_table", "propagate_item_graph", "roc_curve", "session_length_density"):
        text = plan(base.QUERIES[name](spark, FOLDER))
        assert "Python" not in text and "InPandas" not in text, name


def test_graph_flow_shuffles_events_once(spark):
    """Graphs, six rounds, readout and labels from one scan and one exchange."""
    events = materialize(base.labelled(spark, FOLDER))
    for kind in ("event", "item"):
        text = plan(flows.graph_readouts(graphs.graph_events(events), kind))
        assert text.count("Exchange hashpartitioning") == text.count("FileScan") == 1


def test_scores_are_ranked_without_a_second_pass(spark):
    text = plan(base.QUERIES["auc"](spark, FOLDER))
    assert text.count("FileScan") <= 2  # scores, and the totals of their partitions


def test_copies_are_limited_before_the_shuffle(spark, monkeypatch):
    seen = []

    def stop(df, *args):
        seen.append(plan(df))
        raise StopIteration

    monkeypatch.setattr(smote, "materialize", stop)
    df = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "id string, x array<double>")
    try:
        smote.nearest_neighbours(df, "id", "x")
    except StopIteration:
        pass
    lines = seen[0].splitlines()
    limits = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l]
    first_exchange = max(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)  # lowest in the tree
    assert min(limits) < first_exchange < max(limits)


BY_SESSION = r"Exchange hashpartitioning\(user_id#\w+, session#\w+"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_preprocess_shuffles_events_twice(spark, monkeypatch, no_broadcast):
    """To the cells and by session; what comes behind the written events has no exchange by session."""
    plans = []
    write = io.write_bucketed
    monkeypatch.setattr(flows, "write_bucketed", lambda df, *a, **k: (plans.append(plan(df)), write(df, *a, **k))[1])
    events, table = flows.preprocess(clickstream(spark, FOLDER), base.GAP, train_n=100, test_n=50, buckets=6)
    assert len(re.findall(BY_SESSION, plans[0])) == 1 and len(re.findall(r"Exchange hashpartitioning\(user_id#\w+, _cell#\w+", plans[0])) <= 2
    assert "Exchange" not in plans[1] and "Bucketed: true" in plans[1]
    kept = plan(semi(events, table.filter("`set` IS NOT NULL")))
    assert "Exchange" not in kept
    n = base.session_rows(spark, FOLDER).count()
    assert table.count() == n and {r["set"]: r["count"] for r in table.groupBy("set").count().collect()} == {"train": 100, "test": 50, None: n - 150}
    other = base.session_rows(spark, FOLDER)
    assert table.drop("set").select(other.columns).exceptAll(other).isEmpty()


def test_buckets_are_found_again(spark, tmp_path, no_broadcast):
    """One file for each bucket, no name left in the catalog, and the same layout when the folder is read anew."""
    rows = spark.range(1000).selectExpr("id % 90 AS user_id", "id % 7 AS session", "id AS `odd ``name`", "CAST(id AS decimal(12,2)) AS price",
                                        "CAST('2020-01-01' AS timestamp_ntz) AS event_time", "named_struct('a', id, 'b', array(id)) AS nested")
    path = f"{tmp_path}/it's here"
    written = io.write_bucketed(rows, path, buckets=5)
    names = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(names) == len({re.search(r"_(\d{5})\.", f)[1] for f in names}) <= 5
    again = io.read_bucketed(spark, path)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clicktrail")]
    for df in (written, again):
        assert df.exceptAll(rows).isEmpty() and df.count() == 1000
        assert "Exchange" not in plan(df.groupBy("user_id", "session").count())
        assert "Exchange" not in plan(df.join(again.groupBy("user_id", "session").count(), ["user_id", "session"]))
    with pytest.raises(Exception, match="(?i)exist|empty"):
        io.write_bucketed(rows, path, buckets=5)
    plain = new_path(spark, "plain")
    rows.drop("odd `name").write.parquet(plain)
    with pytest.raises(ValueError, match="not bucketed"):
        io.read_bucketed(spark, plain)


def test_empty_tables_keep_their_buckets(spark, tmp_path):
    empty = io.write_bucketed(spark.range(0).selectExpr("id AS user_id", "id AS session"), f"{tmp_path}/none", buckets=3)
    assert empty.count() == 0 and empty.columns == ["user_id", "session"]
