"""Classifiers, the fold loop with scaling and SMOTE inside, and random search.

Each fit is a distributed MLlib job; the loop over folds and candidates is
plain control flow.  Scaling and SMOTE are fitted on the training folds only
and materialised once per fold and ratio, not per candidate.
"""

import hashlib
import math
import random
import threading
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.operators.evaluation import auc, binary_metrics
from clicktrail.operators.sampling import FOLDS, SEED, assign_folds, weight_column, with_balanced_weight
from clicktrail.operators.smote import NEIGHBOURS, RATIOS, nearest_neighbours, smote
from clicktrail.operators.transforms import Scaler, quoted, standard_scale
from clicktrail.spark import materialize, new_path

# Search grids and the number of candidates drawn from each.
GRIDS = {
    "logistic_regression": {
        "C": [10 ** (-4 + 8 * i / 49) for i in range(50)],
        "penalty": ["l1", "l2"],
        "ratio": list(RATIOS),
    },
    "decision_tree": {
        "criterion": ["gini", "entropy"],
        "max_features": ["sqrt", "log2"],
        "min_samples_leaf": [0.00001, 0.0001, 0.001, 0.01],
        "ratio": list(RATIOS),
    },
    "random_forest": {
        "criterion": ["gini", "entropy"],
        "n_estimators": [100, 200, 300],
        "max_features": ["sqrt", "log2"],
        "min_samples_leaf": [0.00001, 0.0001, 0.001, 0.01],
        "ratio": list(RATIOS),
    },
    "gradient_boosting": {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.001, 0.01, 0.1],
        "max_depth": [2, 3, 4, 6, 8],
        "subsample": [0.5, 0.7, 1.0],
        "max_features": ["sqrt", "log2"],
        "ratio": list(RATIOS),
    },
}
CANDIDATES = {"logistic_regression": 100, "decision_tree": 100, "random_forest": 100, "gradient_boosting": 3}

#: Trees grow until their leaves are small or pure; this is as deep as MLlib allows.
MAX_DEPTH = 30

#: Rows of a training table that are worth a task, and rows that a task should not exceed.
TASK_ROWS, MOST_TASK_ROWS = 4096, 262_144

#: Leaves of trees that all fits together grow on the driver at a time, where MLlib keeps them, some 600 bytes a leaf with the nodes above it.
#: A larger forest is grown and written in groups of trees.
DRIVER_LEAVES = 1 << 18

_COLUMNS = dict(featuresCol="features", labelCol="label")


def _weighted(train: DataFrame):
    """Rows with their balanced class weight, and how many they are; counted once per table (see ``_balance``)."""
    if hasattr(train, "_weighted"):
        return train._weighted
    return with_balanced_weight(train, "label"), train.count()


def fit_lr(train: DataFrame, C: float = 1.0, penalty: str = "l2", max_iter: int = 100):
    """Class-weighted logistic regression; the intercept is not penalised."""
    weighted, n = _weighted(train)
    strength = 1.0 / (C * n)
    mix = {"l1": 1.0, "l2": 0.0}[penalty]
    return LogisticRegression(
        **_COLUMNS, weightCol="weight", regParam=strength, elasticNetParam=mix, standardization=False, maxIter=max_iter
    ).fit(weighted)


class _Room:
    """So many leaves for the fits of all threads; a fit that needs more than there are waits for all of them."""

    def __init__(self):
        self.taken, self.change = 0, threading.Condition()

    @contextmanager
    def of(self, leaves: int):
        leaves = min(leaves, DRIVER_LEAVES)
        with self.change:
            self.change.wait_for(lambda: self.taken + leaves <= DRIVER_LEAVES)
            self.taken += leaves
        try:
            yield
        finally:
            with self.change:
                self.taken -= leaves
                self.change.notify_all()


_ROOM = _Room()


@dataclass(frozen=True)
class Forest:
    """A forest in groups of trees, each a written model; the driver and the tasks hold one group at a time.

    Every tree votes with the class shares of its leaf, as in one MLlib forest, and votes are added group by group.
    """

    paths: tuple
    leaves: int  # of a group at most

    def transform(self, df: DataFrame) -> DataFrame:
        votes = vector_to_array("_raw")
        for path in self.paths:
            with _ROOM.of(self.leaves):
                group = RandomForestClassificationModel.load(path).setPredictionCol("").setProbabilityCol("").setRawPredictionCol("_raw")
                df = materialize(group.transform(df).withColumn("_votes", votes).drop("_raw"), "votes")
            votes = F.zip_with("_votes", vector_to_array("_raw"), lambda a, b: a + b)
        total = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
        return df.withColumns({
            "probability": array_to_vector(F.transform("_votes", lambda v: v / total)),
            "prediction": (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"),
        }).drop("_votes")


def _forest(train, criterion, max_features, min_samples_leaf, max_depth, seed, numTrees, **options):
    weighted, n = _weighted(train)
    leaf = max(1, math.ceil(min_samples_leaf * n))
    leaves = max(1, min(1 << max_depth, n // leaf))  # of a tree at most

    def grown(trees, at):
        return RandomForestClassifier(
            **_COLUMNS, weightCol="weight", impurity=criterion, featureSubsetStrategy=max_features,
            minInstancesPerNode=leaf, maxDepth=max_depth, seed=seed + at, numTrees=trees,
            cacheNodeIds=True,  # each row's nodes are kept: no level sends the trees so far to every task, or walks them again from the root
            **options,
        ).fit(weighted)

    if numTrees * leaves <= DRIVER_LEAVES or numTrees == 1:
        with _ROOM.of(numTrees * leaves):
            return grown(numTrees, 0)
    size, paths = max(1, DRIVER_LEAVES // leaves), []
    for at in range(0, numTrees, size):
        trees = min(size, numTrees - at)
        paths.append(new_path(train.sparkSession, "trees"))
        with _ROOM.of(trees * leaves):
            grown(trees, at).write().save(paths[-1])
    return Forest(tuple(paths), size * leaves)


def fit_tree(train: DataFrame, criterion="gini", max_features="sqrt", min_samples_leaf=0.0001, max_depth=MAX_DEPTH, seed=SEED):
    """One class-weighted tree with a feature subset per node."""
    return _forest(train, criterion, max_features, min_samples_leaf, max_depth, seed, numTrees=1, bootstrap=False)


def fit_forest(
    train: DataFrame, criterion="gini", n_estimators=100, max_features="sqrt", min_samples_leaf=0.0001, max_depth=MAX_DEPTH, seed=SEED
):
    return _forest(train, criterion, max_features, min_samples_leaf, max_depth, seed, numTrees=n_estimators)


def fit_gbt(
    train: DataFrame, n_estimators=100, learning_rate=0.1, max_depth=3, subsample=1.0, max_features="sqrt", seed=SEED
):
    return GBTClassifier(
        **_COLUMNS, maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, subsamplingRate=subsample,
        featureSubsetStrategy=max_features, seed=seed,
    ).fit(train)


FITS = {"logistic_regression": fit_lr, "decision_tree": fit_tree, "random_forest": fit_forest, "gradient_boosting": fit_gbt}


def predict(model, df: DataFrame, keep=()) -> DataFrame:
    """``(keep, label, prediction, score)`` with the probability of class 1 as score."""
    return model.transform(df).select(
        *keep, "label", F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


@dataclass(frozen=True)
class Trained:
    """A fitted scaler with the classifier fitted behind it."""

    scaler: Scaler
    columns: tuple
    model: object

    def predict(self, df: DataFrame, label: str, keep=()) -> DataFrame:
        return predict(self.model, _vectors(self.scaler.apply(df), self.columns, label, keep), keep)


def _vectors(df: DataFrame, columns, label: str, keep=()) -> DataFrame:
    features = array_to_vector(F.array(*[F.col(quoted(c)).cast("double") for c in columns]))
    return df.select(*keep, F.col(label).cast("int").alias("label"), features.alias("features"))


def _scale(train: DataFrame, key: str, columns, label: str, k: int, seed: int):
    """Fitted scaler, scaled rows and the neighbours of their minority, the last two materialised."""
    scaler = standard_scale(train, columns)
    rows = materialize(
        scaler.apply(train).select(
            F.col(key).cast("string").alias("_id"),
            F.col(label).cast("int").alias("label"),
            F.array(*[F.col(quoted(c)) for c in columns]).alias("x"),
        )
    )
    return scaler, rows, materialize(nearest_neighbours(rows.filter("label = 1"), "_id", "x", k, seed, exact=False))


def _spread(df: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` rows in as many partitions as there are cores, if each gets ``TASK_ROWS`` rows; in more where they would be too large.

    Written tables are dealt by their bytes, of which training rows have few: iterative fits would run on one or two cores.
    """
    tasks = max(min(n // TASK_ROWS, df.sparkSession.sparkContext.defaultParallelism), -(-n // MOST_TASK_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def _balance(rows: DataFrame, neighbours: DataFrame, ratio: float, k: int, seed: int) -> DataFrame:
    added = smote(rows, "_id", "x", "label", ratio, k, seed, neighbours)
    both = _spread(rows.unionByName(added), rows.count())
    balanced = materialize(both.select("label", array_to_vector("x").alias("features")))
    balanced._weighted = materialize(with_balanced_weight(balanced, "label")), balanced.count()  # every candidate fits on these
    return balanced


def train_pipeline(
    train: DataFrame, key: str, columns, label: str, kind: str, ratio: float = 0.5, k: int = NEIGHBOURS, seed: int = SEED, **params
) -> Trained:
    """Scale, add synthetic minority rows, fit."""
    scaler, rows, neighbours = _scale(train, key, columns, label, k, seed)
    return Trained(scaler, tuple(columns), FITS[kind](_balance(rows, neighbours, ratio, k, seed), **params))


def draw_candidates(grid: dict, n: int, seed: int = 1) -> list:
    """``n`` distinct parameter maps of a grid, all of them where it has fewer."""
    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def _params(candidate: dict) -> dict:
    return {name: v for name, v in candidate.items() if name != "ratio"}


def _f1(kind: str, train: DataFrame, held: DataFrame, params: dict) -> float:
    return float(binary_metrics(predict(FITS[kind](train, **params), held)).first()["f1"])


def _in_threads(spark: SparkSession, function, items, parallelism: int) -> list:
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(function), items))


@dataclass(frozen=True)
class Search:
    results: DataFrame
    best: dict
    trained: Trained


SCORES = "search string, candidate int, ratio double, params string, fold int, f1 double"


def search_name(kind: str, columns, label: str, candidates: list, folds: int, seed: int, fixed: dict) -> str:
    """Digest of all that the scores of a search depend on besides its rows."""
    said = repr([kind, list(columns), label, [sorted(c.items()) for c in candidates], folds, seed, sorted(fixed.items())])
    return hashlib.md5(said.encode()).hexdigest()


def _scores_at(spark: SparkSession, table: str | None, name: str) -> dict:
    """Scores of the search that are already in the table: ``{(candidate, fold): f1}``."""
    if table is None:
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    rows = spark.read.schema(SCORES).parquet(table).filter(F.col("search") == name)
    return {(r["candidate"], r["fold"]): r["f1"] for r in rows.collect()}  # a row per candidate and fold


def random_search(
    train: DataFrame, key: str, columns, label: str, kind: str,
    grid: dict | None = None, n_iter: int | None = None, folds: int = FOLDS, seed: int = SEED, fixed: dict | None = None, parallelism: int = 4,
    table: str | None = None,
) -> Search:
    """Cross-validated search for the best F1 of class 1, refitted on all of train.

    ``results`` has one row per candidate and fold:
    ``(candidate, ratio, params, fold, f1, mean_f1)``.  ``parallelism`` fits run at a time, each being Spark jobs of its own: folds
    side by side first, then candidates of a fold.  A candidate without a rival is refitted beside the folds.

    With ``table``, a path, the scores of fits that ran together are appended to a Parquet table there as soon as they are known.  A search that
    was broken off, with its driver too, goes on from that table when it is started again with the same arguments: fits that it has are not
    repeated, and folds and ratios that it has as a whole are not even balanced.  Folds and synthetic rows come from digests, so they are the same again.
    """
    spark = train.sparkSession
    candidates = draw_candidates(grid or GRIDS[kind], n_iter or CANDIDATES[kind], seed)
    fixed = fixed or {}
    name = search_name(kind, columns, label, candidates, folds, seed, fixed)
    known = _scores_at(spark, table, name)
    folded = materialize(assign_folds(train, key, label, folds, seed))
    refit = lambda best: train_pipeline(folded, key, columns, label, kind, best["ratio"], seed=seed, **_params(best), **fixed)
    todo = {fold: [(n, c) for n, c in enumerate(candidates) if (n, fold) not in known] for fold in range(folds)}
    steps = [fold for fold, tried in todo.items() if tried]
    at_once = max(1, parallelism // max(1, len(steps)))  # of one fold
    append = threading.Lock()  # writers of one table would remove each other's temporary files

    def run(fold):
        if fold is None:
            return refit(candidates[0])
        learn, check = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        scaler, rows, neighbours = _scale(learn, key, columns, label, NEIGHBOURS, seed)
        held = materialize(_vectors(scaler.apply(check), columns, label))
        for ratio in sorted({c["ratio"] for _, c in todo[fold]}):
            balanced = _balance(rows, neighbours, ratio, NEIGHBOURS, seed)
            tried = [(n, c) for n, c in todo[fold] if c["ratio"] == ratio]
            fit = lambda entry: _f1(kind, balanced, held, {**_params(entry[1]), **fixed})
            for at in range(0, len(tried), at_once):
                some = tried[at:at + at_once]
                f1s = _in_threads(spark, fit, some, at_once)
                with append:
                    known.update({(n, fold): f1 for (n, _), f1 in zip(some, f1s)})
                    if table is not None:
                        rows_ = [(name, n, float(c["ratio"]), str(_params(c)), fold, f1) for (n, c), f1 in zip(some, f1s)]
                        spark.createDataFrame(rows_, SCORES).coalesce(1).write.mode("append").parquet(table)

    alone = [None] * (len(candidates) == 1)
    done = _in_threads(spark, run, steps + alone, parallelism)
    scores = [(n, float(c["ratio"]), str(_params(c)), fold, known[n, fold]) for n, c in enumerate(candidates) for fold in range(folds)]
    mean = {n: sum(known[n, fold] for fold in range(folds)) / folds for n in range(len(candidates))}
    best = candidates[max(mean, key=lambda n: (mean[n], -n))]
    schema = "candidate int, ratio double, params string, fold int, f1 double, mean_f1 double"
    results = spark.createDataFrame([(*s, mean[s[0]]) for s in scores], schema)
    return Search(results, best, done[-1] if alone else refit(best))


def search_results(search: Search) -> DataFrame:
    """One row per candidate, best first."""
    per = search.results.groupBy("candidate", "ratio", "params").agg(
        F.avg("f1").alias("mean_test_score"), F.stddev_pop("f1").alias("std_test_score")
    )
    return per.orderBy(F.desc("mean_test_score"), "candidate")


def score_by_param(results: DataFrame, param: str = "ratio", score: str = "f1") -> DataFrame:
    """Mean cross-validation score per value of a parameter."""
    return results.groupBy(param).agg(F.avg(score).alias("mean_test_score"))


@dataclass(frozen=True)
class GraphClassifier:
    """A classifier on graph readouts with the scaling fitted for it.

    Readouts are sums over graphs of any size, so they are long-tailed: they are squashed by a signed logarithm first,
    then scaled to zero mean and unit deviation on the training graphs.
    """

    scaler: Scaler
    columns: tuple
    model: object

    @staticmethod
    def squashed(df: DataFrame, columns) -> DataFrame:
        number = {c: F.col(quoted(c)).cast("double") for c in columns}
        return df.withColumns({c: F.signum(x) * F.log1p(F.abs(x)) for c, x in number.items()})

    def rows(self, readout: DataFrame, label: str, keep=()) -> DataFrame:
        return _vectors(self.scaler.apply(self.squashed(readout, self.columns)), self.columns, label, keep)


def fit_graph_classifier(
    readout: DataFrame, columns, label: str = "label", hidden: int | None = None, weights=None, max_iter: int = 100, seed: int = SEED
) -> GraphClassifier:
    """Classifier on graph readouts: weighted logistic regression, or a hidden layer.

    The network takes no weights; balance its input by replication instead.
    """
    fitted, rows = _graph_rows(readout, columns, label)
    return _fit_graph_rows(fitted, rows, hidden, weights, max_iter, seed)


def _graph_rows(readout: DataFrame, columns, label: str):
    """Fitted scaling without a model, and the scaled rows, materialised."""
    flat = GraphClassifier.squashed(readout, columns)
    fitted = GraphClassifier(standard_scale(flat, columns), tuple(columns), None)
    return fitted, materialize(_spread(fitted.rows(readout, label), readout.count()))


def _fit_graph_rows(fitted: GraphClassifier, rows: DataFrame, hidden: int | None, weights, max_iter: int, seed: int) -> GraphClassifier:
    if hidden:
        layers = [len(fitted.columns), hidden, 2]
        model = MultilayerPerceptronClassifier(**_COLUMNS, layers=layers, maxIter=max_iter, seed=seed).fit(rows)
    elif weights is None:
        model = fit_lr(rows, max_iter=max_iter)
    else:
        weighted = rows.withColumn("weight", weight_column(weights, "label"))
        model = LogisticRegression(**_COLUMNS, weightCol="weight", standardization=True, maxIter=max_iter).fit(weighted)
    return GraphClassifier(fitted.scaler, fitted.columns, model)


def choose_graph_classifier(
    train: DataFrame, validation: DataFrame, columns, label: str = "label", hidden=(4, 8, 16), iterations=(20, 60), seed: int = SEED,
    parallelism: int = 4,
) -> GraphClassifier:
    """The network whose width and number of iterations give the highest AUC on the validation graphs.

    Few iterations are the stop against overfitting; ties go to the smaller network and the shorter training.
    The graphs are scaled once; ``parallelism`` networks are fitted at a time.
    """
    fitted, rows = _graph_rows(train, columns, label)
    held = materialize(fitted.rows(validation, label))

    def tried(size):
        model = _fit_graph_rows(fitted, rows, size[0], None, size[1], seed)
        return model, auc(predict(model.model, held)).first()["auc"]

    best = (-1.0, None)
    for model, area in _in_threads(train.sparkSession, tried, product(hidden, iterations), parallelism):
        if best[1] is None or (area is not None and area > best[0] + 1e-12):
            best = (-1.0 if area is None else area, model)
    return best[1]


def score_graphs(model: GraphClassifier, readout: DataFrame, columns=None, label: str = "label", keep=()) -> DataFrame:
    return predict(model.model, model.rows(readout, label, keep), keep)
