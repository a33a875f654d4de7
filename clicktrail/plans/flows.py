"""The whole job in three steps: prepare events and sessions, tabular models, graph models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail import schemas as S
from clicktrail.functions.calendar import day_name, month_name, week_of_month
from clicktrail.functions.durations import seconds_component
from clicktrail.functions.text import as_int
from clicktrail.operators import evaluation, graphs, models, sampling
from clicktrail.operators.features import enrich, labelled_events, session_table
from clicktrail.operators.rows import append, not_null, only, semi
from clicktrail.operators.sessions import GAP, prepare_sessions
from clicktrail.operators.transforms import min_max
from clicktrail.sources.events import bucket_count, write_bucketed
from clicktrail.spark import materialize, new_path

# Columns that the tabular models leave out or rename.
DROPPED = ["day", "hour", S.TIME, "number_of_purchases", S.SESSION_TEXT]
RENAMED = {
    "weekDay": "week_day",
    "weekDayOrNot": "week_day_or_not",
    "dayTime": "day_time",
    "newVisitorOrNot": "new_visitor_or_not",
    S.LABEL: "purchase_session",
}
CATEGORIES = ["month", "week_day", "day_time", "week_of_the_month"]
#: Kinds of classifier that are searched at a time; boosting is a long row of short jobs, which leave most cores to the others.
KINDS_AT_ONCE = 2
FLAGS = ["week_day_or_not", "new_visitor_or_not"]


def model_columns() -> list:
    """Numbers and flags of the tabular models in table order."""
    return [*FLAGS, *[c for c in S.FEATURES if c not in DROPPED]]


def preprocess(
    raw: DataFrame, gap=GAP, train_n: int = sampling.TRAIN_SIZE, test_n: int = sampling.TEST_SIZE, seed: int = sampling.SEED,
    buckets: int | None = None, exclude_types=(),
):
    """Raw events to labelled events and the session table, both with their ``set``.

    Events are shuffled twice: to their cells, and by session into ``buckets`` (see ``write_bucketed``).  Both tables are written by bucket,
    so the session table, and later every join, window or aggregate by session, reads them without an exchange.  The split marks
    both tables by expression.  Durations of sessions leave out events of ``exclude_types``.
    """
    spark = raw.sparkSession
    buckets = buckets or bucket_count(spark)
    prepared = prepare_sessions(not_null(raw, "user_session"), gap).repartition(buckets, *S.SESSION_KEY)
    events = write_bucketed(labelled_events(enrich(prepared)), new_path(spark, "events"), buckets=buckets, placed=True)
    sessions = write_bucketed(session_table(events, exclude_types), new_path(spark, "sessions"), buckets=buckets, placed=True)
    split = sampling.stratified_split(sessions, train_n=train_n, test_n=test_n, seed=seed)
    return split.assign(events), split.assign(sessions)


def tabular_frame(sessions: DataFrame) -> DataFrame:
    """Session table in the form the tabular models use; the session key is kept."""
    typed = sessions.withColumns(
        {
            "session_length": seconds_component(F.col("session_length")),
            "max_time_between_two_events": seconds_component(F.col("max_time_between_two_events")),
            "week_of_the_month": week_of_month(F.col("day")),
            "month": month_name(F.col("month")),
            "weekDay": day_name(F.col("weekDay")),
            "weekDayOrNot": as_int(F.col("weekDayOrNot")),
            "newVisitorOrNot": as_int(F.col("newVisitorOrNot")),
        }
    )
    return typed.drop(*DROPPED).withColumnsRenamed(RENAMED)


def tabular_models(
    train: DataFrame, test: DataFrame, key: str, columns, label: str = "purchase_session", kinds=tuple(models.GRIDS), grids: dict | None = None, **search
):
    """Search, refit and test a classifier of each kind: ``(searches, metrics, curves)``.

    ``searches`` has the ``models.Search`` of each kind; ``metrics`` a row of test measures per kind with its AUC; ``curves``
    the ROC points of all kinds in one table.  ``KINDS_AT_ONCE`` kinds are searched side by side.  ``grids`` replaces search grids by kind; further arguments go to the search.
    """
    def of_kind(kind):
        search_ = models.random_search(train, key, columns, label, kind, grid=(grids or {}).get(kind), **search)
        scored = materialize(search_.trained.predict(test, label, keep=(key,)))
        area = evaluation.auc(scored).scalar()
        return search_, scored, evaluation.binary_metrics(scored).select(F.lit(kind).alias("model"), "*", area.alias("auc"))

    done = dict(zip(kinds, models._in_threads(train.sparkSession, of_kind, kinds, KINDS_AT_ONCE)))
    searches, scored, metrics = ({kind: of[at] for kind, of in done.items()} for at in range(3))
    return searches, append(*metrics.values()), evaluation.compare_models(scored)


def graph_frames(events: DataFrame, sessions: DataFrame, seed: int = sampling.SEED) -> dict:
    """Events of the graph models per part, balanced and scaled: train, validation, test."""
    kept = semi(events, not_null(sessions, "set"))
    flagged = graphs.graph_events(kept)
    labels = sessions.filter(F.col("set") == "train").select(*S.SESSION_KEY, S.LABEL)
    split = sampling.stratified_fraction_split(labels, seed=seed)
    train = only(split.assign(flagged.filter(F.col("set") == "train"), "part"), "part", "train")
    balanced = materialize(sampling.oversample_sessions(train))
    scaler = min_max(balanced, ["session_time", "price", "hour"])
    held = split.assign(flagged.filter(F.col("set") == "train"), "part")
    return {
        "train": scaler.apply(balanced),
        "validation": scaler.apply(only(held, "part", "validation")),
        "test": scaler.apply(flagged.filter(F.col("set") == "test")),
    }


def graph_readouts(events: DataFrame, kind: str = "event", hops: int = graphs.HOPS, sessions: DataFrame | None = None) -> DataFrame:
    """One row of readout columns per graph, with its label; given sessions, also their length in seconds."""
    readout = graphs.readouts(events, kind, hops)
    if sessions is not None:
        readout = graphs.attach_graph_features(readout, sessions)
        readout = readout.withColumn("session_length", seconds_component(F.col("session_length")))
    return readout
