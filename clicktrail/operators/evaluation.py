"""Evaluation of binary classifiers from rows of label, prediction and score."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.operators.rows import append
from clicktrail.spark import materialize


def _present(column: Column, what: str) -> Column:
    """The column; a row without a value fails the job instead of leaving some measures and not others."""
    return F.when(column.isNull(), F.raise_error(F.lit(f"a row has no {what}"))).otherwise(column)


def confusion_counts(label: Column, predicted: Column) -> dict:
    return {
        "tp": F.count_if((label == 1) & (predicted == 1)),
        "fp": F.count_if((label == 0) & (predicted == 1)),
        "fn": F.count_if((label == 1) & (predicted == 0)),
        "tn": F.count_if((label == 0) & (predicted == 0)),
    }


def confusion(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Counts when the likelier of two classes is predicted; a score of exactly one half is class 0."""
    counts = confusion_counts(F.col(label), (F.col(score) > 0.5).cast("int"))
    return df.agg(*[c.alias(name) for name, c in counts.items()])


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, F1, precision and recall of class 1; 0 where undefined.  One row.  A missing label or prediction fails."""
    c = confusion_counts(_present(F.col(label), "label"), _present(F.col(prediction), "prediction"))

    def ratio(top, bottom):
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    return df.agg(
        ratio(c["tp"] + c["tn"], F.count(F.lit(1))).alias("accuracy"),
        ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"),
        ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
    )


def _ranked_scores(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """Distinct scores, within each group of ``by``, with their positives, negatives and running totals from the highest score down.

    Equal scores are collapsed first, then range partitioned and written once.  Running totals inside a partition
    go on from the totals of the partitions above, of which there is one row each.  A missing label or score fails.
    ``next_pos``/``next_neg`` are the counts at the next lower score.
    """
    label, score = _present(F.col(label), "label"), _present(F.col(score).cast("double"), "score")
    collapsed = df.groupBy(*by, score.alias("score")).agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
    bucketed = materialize(collapsed.repartitionByRange(*by, F.desc("score")).withColumn("bucket", F.spark_partition_id()), "scores")
    down = Window.partitionBy(*by).orderBy("bucket")  # over one row per group and partition
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("_top"),
    )
    offsets = totals.select(
        *by,
        "bucket",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_pos_above"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_neg_above"),
        F.lead("_top").over(down).alias("_next_top"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return bucketed.join(offsets, [*by, "bucket"]).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_pos_above") + F.sum("pos").over(running)).alias("tps"),
        (F.col("_neg_above") + F.sum("neg").over(running)).alias("fps"),
        F.coalesce(F.lead("pos").over(inside), F.col("_next_top.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("_next_top.neg")).alias("next_neg"),
    )


def _area() -> Column:
    # A positive beats every negative with a lower score and half of those with its own.
    beaten = F.sum(F.col("neg").cast("double") * (F.col("tps") - F.col("pos")) + F.col("pos") * F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return (beaten / F.nullif(pairs, F.lit(0.0))).alias("auc")


def _totals() -> list:
    return [F.nullif(F.sum("pos"), F.lit(0)).alias("p"), F.nullif(F.sum("neg"), F.lit(0)).alias("n"), (F.max("score") + 1).alias("top")]


_CORNER = "next_pos <> pos OR next_neg <> neg OR next_pos IS NULL"


def _curve(ranked: DataFrame, drop_intermediate: bool) -> DataFrame:
    totals = ranked.agg(*_totals())
    if drop_intermediate:
        ranked = ranked.filter(_CORNER)
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    points = ranked.select(F.col("score").alias("threshold"), (F.col("fps") / n).alias("fpr"), (F.col("tps") / p).alias("tpr"))
    start = totals.filter("top IS NOT NULL").select(
        F.col("top").alias("threshold"), (F.lit(0) / F.col("n")).alias("fpr"), (F.lit(0) / F.col("p")).alias("tpr")
    )
    return append(start, points)


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when a class is empty.  One row."""
    return _ranked_scores(df, label, score).agg(_area())


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", drop_intermediate: bool = True) -> DataFrame:
    """Points ``(threshold, fpr, tpr)`` of the ROC curve.

    The curve starts at (0, 0) with a threshold one above the highest score.
    Points on a straight line between their neighbours are left out unless
    ``drop_intermediate`` is off.
    """
    return _curve(_ranked_scores(df, label, score), drop_intermediate)


def compare_models(scored: dict, label: str = "label", score: str = "score") -> DataFrame:
    """ROC points and AUC of several models in one table.

    The scores of all models are ranked together, by model and score, in one range partitioned pass with one write, however many they are.
    """
    rows = [df.select(F.lit(name).alias("model"), F.col(label).alias("label"), F.col(score).cast("double").alias("score")) for name, df in scored.items()]
    ranked = _ranked_scores(append(*rows), "label", "score", ["model"])
    totals = materialize(ranked.groupBy("model").agg(*_totals(), _area()), "models")  # a row per model
    start = totals.select("model", F.col("top").alias("threshold"), F.lit(0).alias("fps"), F.lit(0).alias("tps"))
    points = ranked.filter(_CORNER).select("model", F.col("score").alias("threshold"), "fps", "tps")
    return append(start, points).join(totals, "model").select(
        "model", "threshold", (F.col("fps") / F.col("n")).alias("fpr"), (F.col("tps") / F.col("p")).alias("tpr"), F.round("auc", 4).alias("auc"))


def weighted_log_loss(df: DataFrame, label: str = "label", score: str = "score", weights=(1.0, 1.0)) -> DataFrame:
    """Cross-entropy averaged with class weights; scores are clipped away from 0 and 1."""
    p = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - 1e-15)), F.lit(1e-15))
    likelihood = F.when(F.col(label) == 1, p).otherwise(1 - p)
    w = F.when(F.col(label) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    return df.agg((F.sum(-w * F.log(likelihood)) / F.nullif(F.sum(w), F.lit(0.0))).alias("loss"))
