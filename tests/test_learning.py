import hashlib
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.operators import eda, evaluation, graphs, models, sampling, smote, transforms

from clicktrail.spark import new_path
from tests.test_sessions import at


def labelled(spark, n, rare=7):
    return spark.range(n).selectExpr("id AS user_id", "id % 3 AS session", f"CAST(id % {rare} = 0 AS int) AS PurchaseSession")


@pytest.mark.parametrize("train,test", [(0, 0), (10, 0), (0, 10), (100, 50), (333, 667), (1000, 0)])
def test_split_sizes_are_exact(spark, train, test):
    df = labelled(spark, 1000)
    out = sampling.stratified_split(df, train_n=train, test_n=test).assign(df)
    sizes = {(r["set"], r.PurchaseSession): r["count"] for r in out.groupBy("set", "PurchaseSession").count().collect()}
    for part, total in (("train", train), ("test", test)):
        assert sum(n for (p, _), n in sizes.items() if p == part) == total
        positive = sizes.get((part, 1), 0)
        assert abs(positive - total * 143 / 1000) <= 1.5


def test_split_asks_for_too_much(spark):
    with pytest.raises(ValueError):
        sampling.stratified_split(labelled(spark, 10), train_n=9, test_n=9)


def test_fraction_split_rounds_up(spark):
    df = labelled(spark, 101)
    out = sampling.stratified_fraction_split(df).assign(df, "part")
    sizes = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
    assert sizes == {"train": 101 - math.ceil(0.3 * 101), "validation": math.ceil(0.3 * 101)}


def test_folds_are_even_and_rank_is_dense(spark):
    df = labelled(spark, 500)
    folds = sampling.assign_folds(df).groupBy("PurchaseSession", "fold").count().collect()
    for value in (0, 1):
        counts = [r["count"] for r in folds if r.PurchaseSession == value]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    ranks = sampling.stratified_rank(df, ["user_id", "session"], "PurchaseSession")
    assert sorted(r["rank"] for r in ranks.filter("PurchaseSession = 1").collect()) == list(range(72))


def test_cuts_by_rounds_of_counts(spark, monkeypatch):
    """Buckets of a few rows, digits one by one: the cuts are the digests that a sort of the whole class gives."""
    df = labelled(spark, 3000)
    whole = sampling.stratified_split(df, train_n=701, test_n=299)
    monkeypatch.setattr(sampling, "_LISTED", 2)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    rounds = []
    counts = sampling._bucket_counts
    monkeypatch.setattr(sampling, "_bucket_counts", lambda keyed, buckets, digits: rounds.append(digits) or counts(keyed, buckets, digits))
    assert sampling.stratified_split(df, train_n=701, test_n=299).cuts == whole.cuts and len(rounds) > 2
    digests = {}
    for r in df.select("PurchaseSession", sampling.seeded_digest(42, F.col("user_id"), F.col("session")).alias("d")).collect():
        digests.setdefault(r.PurchaseSession, []).append(r.d)
    sizes = sampling.allocate({v: len(d) for v, d in digests.items()}, 701)
    assert {v: sorted(d)[sizes[v] - 1] for v, d in digests.items()} == {v: cut[0] for v, cut in whole.cuts.items()}


@pytest.mark.parametrize("most", [7, 60, 10**6])
def test_ranks_are_dense_at_any_bucket_size(spark, monkeypatch, most):
    monkeypatch.setattr(sampling, "_RANKED", most)
    df = labelled(spark, 1000)
    ranks = sampling.stratified_rank(df, ["user_id", "session"], "PurchaseSession").collect()
    for value in (0, 1):
        own = sorted((r for r in ranks if r.PurchaseSession == value), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: hashlib.md5(f"42|{r.user_id}_{r.session}".encode()).hexdigest())


def test_allocate_prefers_large_remainders():
    assert sampling.allocate({0: 97, 1: 3}, 10) == {0: 10, 1: 0}
    assert sampling.allocate({0: 5, 1: 5}, 3) == {0: 2, 1: 1}


def test_oversampling_keeps_originals(spark):
    df = spark.range(340).selectExpr("id AS user_id", "0 AS session", "CAST(id % 34 = 0 AS int) AS PurchaseSession",
                                     "concat(id, '_0') AS user_session_id_new")
    out = sampling.oversample_sessions(df)  # 33 to 1: int(33 / 8) = 4 copies
    assert out.filter("copy_no = 0").count() == 340
    assert {r.user_session_id_new for r in out.filter("user_id = 34").collect()} == {"34_0", "34_0D0", "34_0D1", "34_0D2", "34_0D3"}
    assert out.filter("PurchaseSession = 0 AND copy_no > 0").count() == 0


def test_oversampling_with_an_empty_class(spark):
    df = spark.range(5).selectExpr("id AS user_id", "0 AS session", "0 AS PurchaseSession")
    assert sampling.oversample_sessions(df).count() == 5


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 4), (3.0, 4)], "a double, b int")
    z = transforms.standard_scale(df, ["a", "b"]).apply(df).collect()
    assert [tuple(r) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]
    fitted = transforms.min_max(df, ["a", "b"])
    other = spark.createDataFrame([(5.0, 5)], "a double, b int")
    assert tuple(fitted.apply(other).first()) == (2.0, 1.0)


def test_correlated_features_count_dropped_ones(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -3.0 * i, float(i % 2)) for i in range(10)], "a double, b double, c double, d double")
    assert {r.feature for r in transforms.correlated_features(df, ["a", "b", "c", "d"]).collect()} == {"b", "c"}


def test_one_hot_uses_fitted_levels(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    encoder = transforms.one_hot(train, ["c"], drop_first=True)
    test = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    assert encoder.names == ["c_b"]
    assert [r.c_b for r in encoder.apply(test).collect()] == [1, 0, 0]


# Evaluation


def brute_auc(cases):
    pos = [s for y, s in cases if y == 1]
    neg = [s for y, s in cases if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits,n", [(0, 50), (1, 400), (12, 700)])
def test_auc_with_ties(spark, digits, n):
    rng = random.Random(digits)
    cases = [(int(rng.random() < 0.3), round(rng.random() ** 3, digits)) for _ in range(n)]
    df = spark.createDataFrame(cases, "label int, score double")
    assert evaluation.auc(df).first().auc == pytest.approx(brute_auc(cases), abs=1e-12)


def test_auc_edge_cases(spark):
    tied = spark.createDataFrame([(i % 2, 0.5) for i in range(6)], "label int, score double")
    assert evaluation.auc(tied).first().auc == 0.5
    single = spark.createDataFrame([(1, 0.1), (1, 0.2)], "label int, score double")
    assert evaluation.auc(single).first().auc is None
    m = evaluation.binary_metrics(single.selectExpr("0 AS label", "0 AS prediction")).first()
    assert (m.accuracy, m.f1, m["precision"], m.recall) == (1.0, 0.0, 0.0, 0.0)


def test_roc_area_equals_auc(spark):
    rng = random.Random(3)
    cases = [(int(rng.random() < 0.4), rng.random()) for _ in range(900)]
    df = spark.createDataFrame(cases, "label int, score double")
    for drop in (True, False):
        points = sorted((r.fpr, r.tpr) for r in evaluation.roc_curve(df, drop_intermediate=drop).collect())
        assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
        assert area == pytest.approx(brute_auc(cases), abs=1e-9)
        assert len(points) == (len(points) if drop else 901)


def test_log_loss(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4)], "label int, score double")
    expected = (-3 * math.log(0.8) - math.log(0.6)) / 4
    assert evaluation.weighted_log_loss(df, weights=(1, 3)).first().loss == pytest.approx(expected)


# Neighbours and synthetic rows


@pytest.mark.parametrize("copies", [False, True])
def test_neighbours_are_exact(spark, monkeypatch, copies):
    """Many pivots and small blocks, against brute force; a third of the rows may be copies."""
    monkeypatch.setattr(smote, "_BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 60, size=(240, 3)).astype(float)
    if copies:
        x[:80] = x[0]
    df = spark.createDataFrame([(f"{i:03}", row.tolist()) for i, row in enumerate(x)], "id string, x array<double>")
    got = {}
    for r in smote.nearest_neighbours(df, "id", "x", k=5).orderBy("id", "rank").collect():
        got.setdefault(int(r.id), []).append(int(r.nn))
    for i in range(len(x)):
        distance = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((d, j) for j, d in enumerate(distance) if j != i)
        assert got[i] == [j for _, j in order[:5]], i


@pytest.mark.parametrize("kind", ["latent", "sessions"])
def test_projected_neighbours_are_found(spark, monkeypatch, kind):
    """25 columns, buckets and groups of few rows: recall against the exact table, and distances that are right."""
    monkeypatch.setattr(smote, "BUCKET", 128)
    monkeypatch.setattr(smote, "_GROUP", 500)
    rng = np.random.default_rng(2)
    if kind == "latent":
        x = rng.normal(size=(1500, 5)) @ rng.normal(size=(5, 25)) + 0.05 * rng.normal(size=(1500, 25))
    else:
        z = np.exp(rng.normal(size=(1500, 6)))
        x = np.concatenate([np.round(3 * z), np.round(z * z, 2), z[:, :5] * rng.random((1500, 5)), rng.integers(0, 2, (1500, 8))], 1)
    x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    x[:100] = x[0]  # copies stay out of the buckets
    df = spark.createDataFrame([(f"{i:04}", row.tolist()) for i, row in enumerate(x)], "id string, x array<double>")
    lists = [{}, {}]
    for exact, out in zip((True, False), lists):
        for r in smote.nearest_neighbours(df, "id", "x", exact=exact).collect():
            out.setdefault(r.id, {})[r.nn] = r.distance
            assert r.distance == pytest.approx(float(np.linalg.norm(x[int(r.id)] - x[int(r.nn)])), abs=1e-9)
    truth, got = lists
    assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(truth[i].keys() & got[i].keys()) / 5 for i in truth]) >= 0.95


def test_projected_buckets_bound_the_visits(monkeypatch):
    """However large a group is, a row meets the rows of one bucket."""
    import pandas as pd

    monkeypatch.setattr(smote, "BUCKET", 64)
    met = []
    monkeypatch.setattr(smote, "_nearest", lambda a, b, k: met.append(len(b)) or pd.DataFrame({"id": a["id"]}))
    rng = np.random.default_rng(1)
    for n in (50, 1000, 4000):
        met.clear()
        group = pd.DataFrame({"tree": 3, "leaf": 0, "id": np.arange(n), "x": list(rng.normal(size=(n, 25)))})
        assert sorted(smote._in_buckets(group, 5, 42)["id"]) == list(range(n)) and max(met) <= 64 and sum(met) == n


def test_few_rows_have_fewer_neighbours(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "id string, x array<double>")
    assert smote.nearest_neighbours(df, "id", "x", k=5).count() == 6


def test_smote_reaches_the_ratio_on_the_lines(spark):
    rows = [(f"m{i}", [float(i), 2.0 * i], 1) for i in range(10)] + [(f"n{i}", [0.0, 0.0], 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, x array<double>, label int")
    new = smote.smote(df, "id", "x", "label", 0.35).collect()
    assert len(new) == 25 and len({r.id for r in new}) == 25
    assert all(r.label == 1 and r.x[1] == pytest.approx(2 * r.x[0]) and 0 <= r.x[0] <= 9 for r in new)
    again = smote.smote(df.repartition(5), "id", "x", "label", 0.35).collect()
    assert sorted((r.id, r.x) for r in new) == sorted((r.id, r.x) for r in again)
    assert smote.smote(df, "id", "x", "label", 0.05).count() == 0


# Graphs


def graph_rows(events):
    products = [1, 1, 2, 1, 3]
    df = events([(1, at(i), "view" if i % 2 == 0 else "cart", p, f"{i + 1}.00") for i, p in enumerate(products)])
    return df.withColumns({"session": F.lit(0), "PurchaseSession": F.lit(1)})


def test_item_graph_keeps_loops_and_parallel_edges(events):
    nodes, edges = graphs.item_graph(graphs.graph_events(graph_rows(events)))
    assert [tuple(r) for r in nodes.orderBy("node").select("n_views", "n_carts", "price").collect()] == [(1, 2, 1.0), (1, 0, 3.0), (1, 0, 5.0)]
    got = sorted((r.src, r.dst) for r in edges.collect())
    assert got == sorted([(0, 0), (0, 1), (1, 0), (0, 2), (0, 0), (1, 0), (0, 1), (2, 0)])


def test_event_graph_and_propagation_against_matrices(events):
    source = graphs.graph_events(graph_rows(events))
    for build, features in ((graphs.event_graph, graphs.EVENT_FEATURES), (graphs.item_graph, graphs.ITEM_FEATURES)):
        nodes, edges = build(source)
        listed, links = nodes.orderBy("node").collect(), edges.collect()
        n = len(listed)
        a = np.zeros((n, n))
        for e in links:
            a[e.dst, e.src] += 1
        norm = a / np.sqrt(np.outer(a.sum(axis=1), a.sum(axis=0)))
        x = np.array([[float(r[f]) for f in features] for r in listed])
        got = graphs.propagate(nodes, edges, features, 3).orderBy("node").collect()
        for h in range(4):
            assert np.allclose([[r[f"{f}_{h}"] for f in features] for r in got], x)
            x = norm @ x


def test_one_pass_readout_equals_the_steps(spark, events):
    rng = random.Random(5)
    rows = [(u, at(60 * k), rng.choice(["view", "cart", "view", "purchase"]), rng.randint(1, 4), f"{rng.randint(1, 90)}.50")
            for u in range(12) for k in range(rng.randint(1, 14))]
    df = events(rows).withColumns({"session": F.col("user_id") % 2, "PurchaseSession": (F.col("user_id") % 3 == 0).cast("int")})
    source = graphs.graph_events(df)
    for kind, build, features in (("event", graphs.event_graph, graphs.EVENT_FEATURES), ("item", graphs.item_graph, graphs.ITEM_FEATURES)):
        steps = graphs.graph_readout(graphs.propagate(*build(source), features), graphs.hop_names(features)).join(graphs.graph_table(source), graphs.GRAPH_KEY)
        names = [*graphs.GRAPH_KEY, "label", *graphs.readout_names(features)]
        one, other = (sorted(tuple(r) for r in x.select(names).collect()) for x in (graphs.readouts(source, kind), steps))
        assert len(one) == len(other) > 5 and np.allclose(np.array(one, float), np.array(other, float))


def test_rounds_by_join_equal_the_rows(spark, events):
    rng = random.Random(6)
    rows = [(u, at(60 * k), rng.choice(["view", "cart"]), rng.randint(1, 4), f"{rng.randint(1, 90)}.50") for u in range(9) for k in range(rng.randint(1, 12))]
    source = graphs.graph_events(events(rows).withColumns({"session": F.lit(0), "PurchaseSession": F.lit(1)}))
    for build, features in ((graphs.event_graph, graphs.EVENT_FEATURES), (graphs.item_graph, graphs.ITEM_FEATURES)):
        nodes, edges = build(source)
        names = [*graphs.GRAPH_KEY, "node", *graphs.hop_names(features, 3)]
        one, other = (sorted(tuple(r) for r in f(nodes, edges, features, 3).select(names).collect()) for f in (graphs.propagate, graphs.propagate_by_join))
        assert np.allclose(np.array(one, float), np.array(other, float))


def test_a_graph_of_a_million_nodes(spark):
    """A ring with a hub that a hundred thousand nodes are linked to, against dense sums; the form that gathers a graph refuses it."""
    n, hops = 1_000_000, 2
    key = ["CAST(1 AS LONG) AS user_id", "CAST(0 AS LONG) AS session", "0 AS copy_no"]
    nodes = spark.range(n).selectExpr(*key, "CAST(id AS INT) AS node", "CAST(id % 97 AS DOUBLE) AS f")
    ring = spark.range(n).selectExpr(*key, "CAST(id AS INT) AS src", f"CAST((id + 1) % {n} AS INT) AS dst")
    hub = spark.range(100_000).selectExpr(*key, "CAST(id * 10 AS INT) AS src", "0 AS dst")
    got = graphs.propagate_by_join(nodes, ring.union(hub), ["f"], hops).select("node", "f_1", "f_2").toPandas().sort_values("node")
    src = np.concatenate([np.arange(n), np.arange(100_000) * 10])
    dst = np.concatenate([(np.arange(n) + 1) % n, np.zeros(100_000, int)])
    weight = 1 / np.sqrt(np.bincount(src, minlength=n)[src] * np.bincount(dst, minlength=n)[dst])
    x = (np.arange(n) % 97).astype(float)
    for h in range(1, hops + 1):
        x = np.bincount(dst, x[src] * weight, n)
        assert np.allclose(got[f"f_{h}"].to_numpy(), x)
    with pytest.raises(Exception, match="propagate_by_join"):
        graphs.propagate(nodes.limit(graphs.MAX_EVENTS + 1), ring.limit(5), ["f"], 1).count()


def test_readout_sum_is_n_times_mean(events):
    nodes, _ = graphs.event_graph(graphs.graph_events(graph_rows(events)))
    r = graphs.graph_readout(nodes, ["price"]).first()
    assert r.price_sum == pytest.approx(nodes.count() * r.price_mean) and r.price_max == 5.0


def test_edges_per_graph(events):
    nodes, edges = graphs.event_graph(graphs.graph_events(graph_rows(events)))
    assert edges.count() == 2 * (nodes.count() - 1)


def test_propagation_without_edges(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0, 2.0)], "user_id long, session long, copy_no int, node int, f double")
    edges = spark.createDataFrame([], "user_id long, session long, copy_no int, src int, dst int")
    assert tuple(graphs.propagate(nodes, edges, ["f"], 2).select("f_0", "f_1", "f_2").first()) == (2.0, 0.0, 0.0)


# Models


@pytest.fixture(scope="module")
def signal(spark):
    """A planted signal: class 1 where a + noise is large."""
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = (a + 0.3 * rng.normal(size=300) > 0.8).astype(int)
    rows = [(i, float(u), float(v), int(w)) for i, (u, v, w) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, y int").repartition(2).cache()


@pytest.mark.parametrize("kind,params", [
    ("logistic_regression", {"C": 1.0}), ("decision_tree", {"max_depth": 4}),
    ("random_forest", {"n_estimators": 5, "max_depth": 4}), ("gradient_boosting", {"n_estimators": 5, "max_depth": 2}),
])
def test_models_find_a_planted_signal(signal, kind, params):
    scores = []
    for _ in range(2):
        trained = models.train_pipeline(signal, "id", ["a", "b"], "y", kind, ratio=0.5, **params)
        scores.append(evaluation.auc(trained.predict(signal, "y")).first().auc)
    assert scores[0] > 0.8
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_search(signal):
    grid = {"C": [0.001, 1.0], "penalty": ["l2"], "ratio": [0.4, 0.5]}
    found = models.random_search(signal, "id", ["a", "b"], "y", "logistic_regression", grid, 3, folds=2, fixed={"max_iter": 10})
    table = models.search_results(found).collect()
    assert len(table) == 3 and found.results.count() == 6
    assert table[0].mean_test_score == max(r.mean_test_score for r in table)
    assert {r.ratio for r in models.score_by_param(found.results).collect()} <= {0.4, 0.5}
    f1 = evaluation.binary_metrics(found.trained.predict(signal, "y")).first().f1
    assert f1 > 0.5


def test_a_search_goes_on_from_its_table(spark, signal, monkeypatch):
    """The driver is lost after some scores; started again, only the others are fitted, and the result is that of one go."""
    table = new_path(spark, "scores")
    grid = {"C": [0.001, 0.1, 1.0], "penalty": ["l2"], "ratio": [0.4, 0.5]}
    search = lambda **kw: models.random_search(
        signal, "id", ["a", "b"], "y", "logistic_regression", grid, 6, folds=2, fixed={"max_iter": 5}, parallelism=2, **kw)
    fits, f1 = [], models._f1

    def lost(*args):
        fits.append(1)
        if len(fits) > 7:
            raise KeyboardInterrupt
        return f1(*args)

    monkeypatch.setattr(models, "_f1", lost)
    with pytest.raises(KeyboardInterrupt):
        search(table=table)
    kept = spark.read.parquet(table).count()
    assert 4 <= kept <= 7
    again = []
    monkeypatch.setattr(models, "_f1", lambda *args: again.append(1) or f1(*args))
    found = search(table=table)
    assert len(again) == 12 - kept and spark.read.parquet(table).count() == 12
    whole = search()
    assert found.best == whole.best and sorted(map(tuple, found.results.collect())) == sorted(map(tuple, whole.results.collect()))
    again.clear()
    search(table=table)
    assert not again


def test_grids_have_the_right_sizes():
    sizes = {k: math.prod(len(v) for v in g.values()) for k, g in models.GRIDS.items()}
    assert sizes == {"logistic_regression": 300, "decision_tree": 48, "random_forest": 144, "gradient_boosting": 810}
    drawn = {k: len(models.draw_candidates(models.GRIDS[k], models.CANDIDATES[k])) for k in sizes}
    assert drawn == {"logistic_regression": 100, "decision_tree": 48, "random_forest": 100, "gradient_boosting": 3}


def test_graph_network_finds_a_planted_signal(spark):
    """Long-tailed readouts of very different size, as sums over graphs are."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.normal(size=400)
    y = (a - 0.5 * b + 0.2 * rng.normal(size=400) > 0.4).astype(int)
    rows = [(int(v), float(math.exp(3 * p)), float(1e9 * math.exp(q)), 7.0) for v, p, q in zip(y, a, b)]
    df = spark.createDataFrame(rows, "label int, `a.sum` double, session_length double, constant double")
    columns = ["a.sum", "session_length", "constant"]
    train, valid, test = df.limit(200).cache(), df.offset(200).limit(100).cache(), df.offset(300).cache()
    model = models.choose_graph_classifier(train, valid, columns, hidden=(4,), iterations=(10, 40))
    scores = models.score_graphs(model, test)
    assert scores.select("score").distinct().count() > 50
    assert evaluation.auc(scores).first().auc > 0.8
    assert evaluation.auc(models.score_graphs(models.fit_graph_classifier(train, columns, weights={0: 1.0, 1: 2.0}), test)).first().auc > 0.8


def test_missing_scores_fail(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (0, None, 0), (None, 0.2, 1)], "label int, score double, prediction int")
    for measure in (evaluation.auc, evaluation.roc_curve, evaluation.binary_metrics):
        with pytest.raises(Exception, match="has no"):
            measure(df).collect()


def test_dotted_levels_and_bounded_levels(spark, monkeypatch):
    train = spark.createDataFrame([("a.b", 1.0), ("c", 2.0)], "`code.x` string, v double")
    encoder = transforms.one_hot(train, ["code.x"])
    out = encoder.apply(train)
    assert encoder.names == ["code.x_a.b", "code.x_c"] and transforms.standard_scale(out, encoder.names).apply(out).count() == 2
    assert transforms.assemble(out, encoder.names).select("features").count() == 2
    monkeypatch.setattr(transforms, "MAX_LEVELS", 1)
    with pytest.raises(ValueError):
        transforms.one_hot(train, ["code.x"])


def test_density_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [r.density for r in eda.kde(df, "v", 0.0, 4.0, 5).collect()] == [None] * 5


def test_searches_draw_by_seed():
    assert models.draw_candidates(models.GRIDS["random_forest"], 10, 1) != models.draw_candidates(models.GRIDS["random_forest"], 10, 2)


def test_prices_are_not_rounded_or_lost(spark, tmp_path):
    from clicktrail.sources.events import read_events

    path = str(tmp_path / "e.csv")
    row = "2020-01-01 00:00:00 UTC,view,1,2,a.b,x,{},1,s,{}"
    with open(path, "w") as f:
        f.write("event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session,event_id\n")
        f.write("\n".join(row.format(p, i) for i, p in enumerate(["1.999", "12345678901.5"])) + "\n")
    assert sorted(float(r.price) for r in read_events(spark, path).collect()) == [1.999, 12345678901.5]
    with open(path, "a") as f:
        f.write(row.format("dear", 3) + "\n")
    with pytest.raises(Exception, match="unreadable price"):
        read_events(spark, path).collect()
    assert read_events(spark, path, unreadable="null").where("price IS NULL").count() == 1


def test_all_kinds_are_searched_and_compared(signal):
    from clicktrail.plans import flows

    grids = {
        "logistic_regression": {"C": [1.0], "penalty": ["l2"], "ratio": [0.5]},
        "decision_tree": {"min_samples_leaf": [0.01], "ratio": [0.5]},
        "random_forest": {"n_estimators": [5], "ratio": [0.5]},
        "gradient_boosting": {"n_estimators": [5], "max_depth": [2], "ratio": [0.5]},
    }
    searches, metrics, curves = flows.tabular_models(signal, signal, "id", ["a", "b"], "y", grids=grids, n_iter=1, folds=2)
    table = {r.model: r for r in metrics.collect()}
    assert set(table) == set(searches) == set(models.GRIDS) and all(r.auc > 0.8 for r in table.values())
    assert {r.model for r in curves.select("model").distinct().collect()} == set(models.GRIDS)
    assert all(models.search_results(s).count() == 1 for s in searches.values())


def test_models_are_compared_in_one_pass(spark):
    """Any number of models: points and areas are those of each alone, from one written table."""
    rng = random.Random(7)
    scored = {f"m{k}": spark.createDataFrame([(rng.randint(0, 1), rng.randint(0, 20 + k) / 20) for _ in range(300)], "label int, score double") for k in range(5)}
    written = []
    real = evaluation.materialize
    evaluation.materialize = lambda df, name="table": written.append(name) or real(df, name)
    try:
        got = evaluation.compare_models(scored).collect()
    finally:
        evaluation.materialize = real
    assert written == ["scores", "models"]
    for name, df in scored.items():
        own = sorted((r.threshold, r.fpr, r.tpr) for r in got if r.model == name)
        assert own == sorted(map(tuple, evaluation.roc_curve(df).collect()))
        assert {r.auc for r in got if r.model == name} == {round(evaluation.auc(df).first().auc, 4)}


def test_a_forest_keeps_the_nodes_of_its_rows(signal):
    """Without, every level sends all trees so far to every task."""
    rows = models._vectors(signal, ["a", "b"], "y")
    for fit, options in ((models.fit_tree, {}), (models.fit_forest, {"n_estimators": 3})):
        assert fit(rows, max_depth=4, **options).getOrDefault("cacheNodeIds")


def _together(monkeypatch, name, n):
    """``models.<name>`` goes on only once ``n`` calls of it run at a time."""
    meet, real = threading.Barrier(n, timeout=60), getattr(models, name)
    monkeypatch.setattr(models, name, lambda *args, **kw: (meet.wait(), real(*args, **kw))[1])


def test_folds_are_searched_side_by_side(signal, monkeypatch):
    grid = {"C": [1.0], "penalty": ["l2"], "ratio": [0.5]}
    search = lambda: models.random_search(signal, "id", ["a", "b"], "y", "logistic_regression", grid, 1, folds=2, fixed={"max_iter": 5})
    alone = sorted(map(tuple, search().results.collect()))
    _together(monkeypatch, "_f1", 2)
    assert sorted(map(tuple, search().results.collect())) == alone


def test_kinds_are_searched_side_by_side(signal, monkeypatch):
    from clicktrail.plans import flows

    kinds = ("logistic_regression", "decision_tree")
    grids = {"logistic_regression": {"C": [1.0], "ratio": [0.5]}, "decision_tree": {"min_samples_leaf": [0.01], "ratio": [0.5]}}
    _together(monkeypatch, "random_search", 2)
    searches, metrics, _ = flows.tabular_models(signal, signal, "id", ["a", "b"], "y", kinds, grids, n_iter=1, folds=2)
    assert tuple(searches) == kinds and [r.model for r in metrics.collect()] == list(kinds)


def test_training_rows_are_spread_over_the_cores(signal, monkeypatch):
    """Written in one partition, as small tables are."""
    one = signal.coalesce(1)
    _, rows, near = models._scale(one, "id", ["a", "b"], "y", 5, 42)
    whole = sorted(map(str, models._balance(rows, near, 0.5, 5, 42).collect()))
    monkeypatch.setattr(models, "TASK_ROWS", 60)
    spread = models._balance(rows, near, 0.5, 5, 42)
    assert spread.rdd.getNumPartitions() == spread._weighted[0].rdd.getNumPartitions() == 5
    assert sorted(map(str, spread.collect())) == whole


def test_networks_are_fitted_side_by_side_on_graphs_scaled_once(spark, signal, monkeypatch):
    columns, scaled, real = ["a", "b"], [], models.standard_scale
    expected = [models.fit_graph_classifier(signal, columns, "y", 2, max_iter=steps) for steps in (5, 30)]
    areas = [evaluation.auc(models.score_graphs(m, signal, columns, "y")).first().auc for m in expected]
    monkeypatch.setattr(models, "standard_scale", lambda *args: scaled.append(1) or real(*args))
    _together(monkeypatch, "_fit_graph_rows", 2)
    best = models.choose_graph_classifier(signal, signal, columns, "y", hidden=(2,), iterations=(5, 30))
    assert scaled == [1] and evaluation.auc(models.score_graphs(best, signal, columns, "y")).first().auc == pytest.approx(max(areas))


def _searched(monkeypatch, module, query):
    """What a registered query asks of ``random_search``."""
    from checks import modelling

    asked = []
    monkeypatch.setattr(modelling, "model_tables", lambda spark, folder: ("train", "test", ["a"]))
    monkeypatch.setattr(module, "random_search", lambda *args, **kw: asked.append((args, kw)))
    try:
        getattr(modelling, query)(None, None)
    except AttributeError:  # the search is not there
        pass
    return asked


@pytest.mark.parametrize("query", ["random_search_results", "score_by_ratio"])
def test_the_registered_search_is_whole(monkeypatch, query):
    """All candidates, all folds and the whole grid, as ``random_search`` has them when nothing is named."""
    assert _searched(monkeypatch, models, query) == [(("train", "id", ["a"], "purchase_session", "logistic_regression"), {})]


def test_the_registered_models_are_searched_whole(monkeypatch):
    from clicktrail.plans import flows

    asked = []
    monkeypatch.setattr(flows, "tabular_models", lambda *args, **kw: asked.append((args, kw)) or [None, None])
    monkeypatch.setattr("checks.modelling.model_tables", lambda spark, folder: ("train", "test", ["a"]))
    from checks import modelling

    modelling.tabular_models(None, None)
    assert asked == [(("train", "test", "id", ["a"]), {})]


def test_a_large_forest_is_grown_in_groups(signal, monkeypatch):
    """No more leaves on the driver at a time than there is room for, and the votes of all trees."""
    rows = models._vectors(signal, ["a", "b"], "y", ("id",))
    fit = lambda: models.fit_forest(rows, n_estimators=7, max_depth=3)
    assert fit().getNumTrees == 7
    monkeypatch.setattr(models, "DRIVER_LEAVES", 24)
    held, of = [], models._ROOM.of
    monkeypatch.setattr(models._ROOM, "of", lambda leaves: held.append(leaves) or of(leaves))
    forest = fit()
    groups = [models.RandomForestClassificationModel.load(path) for path in forest.paths]
    assert [g.getNumTrees for g in groups] == [3, 3, 1] and max(held) <= 24 and sum(held) == 7 * 8
    assert len({t.toDebugString.split("\n", 1)[1] for g in groups for t in g.trees}) > 3  # groups are not the same trees again
    got = {r.id: r for r in models.predict(forest, rows, ("id",)).collect()}
    votes = dict.fromkeys(got, 0.0)
    for g in groups:
        for r in models.predict(g, rows, ("id",)).collect():
            votes[r.id] += r.score * g.getNumTrees / 7
    assert len(got) == 300
    for i, r in got.items():
        assert r.score == pytest.approx(votes[i]) and r.prediction == int(r.score > 0.5)
    assert evaluation.auc(models.predict(forest, rows)).first().auc > 0.8


def test_fits_share_the_room_on_the_driver(monkeypatch):
    monkeypatch.setattr(models, "DRIVER_LEAVES", 10)
    room, most, lock = models._Room(), [0], threading.Lock()

    def fit(leaves):
        with room.of(leaves):
            with lock:
                most[0] = max(most[0], room.taken)
            assert room.taken <= 10

    threads = [threading.Thread(target=fit, args=(leaves,)) for leaves in (4, 6, 50, 10, 3, 3) * 5]
    for t in threads:
        t.start()
    for t in threads:
        t.join(30)
    assert room.taken == 0 and most[0] == 10
