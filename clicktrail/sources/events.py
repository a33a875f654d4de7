"""Reading and writing event and session tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail import schemas as S
from clicktrail.functions.calendar import parse_event_time
from clicktrail.functions.durations import parse_timedelta
from clicktrail.spark import materialize


def _read(spark: SparkSession, path, fmt: str) -> DataFrame:
    if fmt == "csv":
        # Names come from the header line, so files may order columns freely;
        # types are cast from the schema, which saves an inference pass.
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def _casts(df: DataFrame, schema: T.StructType) -> tuple[dict, dict]:
    """Casts of the known columns that need one, and for each an expression: why its value cannot be read, or NULL."""
    present = {f.name: f.dataType for f in df.schema}
    casts, reasons = {}, {}
    for field in schema:
        source = present.get(field.name)
        if source is None or source == field.dataType:
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(source, T.StringType):
            cast = parse_event_time(column)
        elif field.name in S.DURATIONS and isinstance(source, T.StringType):
            # Either microseconds or a text such as "0 days 00:12:30".
            cast = F.coalesce(column.try_cast("bigint"), parse_timedelta(column))
        else:
            cast = column.try_cast(field.dataType)
        text = column.cast("string")
        why = F.when(text.isNotNull() & cast.isNull(), F.concat(F.lit(f"unreadable {field.name}: "), text))
        if isinstance(field.dataType, T.DecimalType) and isinstance(source, T.StringType):
            # A text with more places than the type has would be rounded.
            why = why.when(column.try_cast("decimal(38,18)") != cast, F.concat(F.lit(f"more than {field.dataType.scale} places in {field.name}: "), text))
        casts[field.name], reasons[field.name] = cast, why
    return casts, reasons


def _typed(df: DataFrame, schema: T.StructType, unreadable: str) -> DataFrame:
    """Cast the known columns; unreadable values fail, or become NULL if ``unreadable`` is ``null``; other columns stay."""
    if unreadable not in ("raise", "null"):
        raise ValueError("unreadable is either raise or null")
    casts, reasons = _casts(df, schema)
    if unreadable == "raise":
        casts = {name: F.when(reasons[name].isNotNull(), F.raise_error(reasons[name])).otherwise(cast) for name, cast in casts.items()}
    return df.withColumns(casts) if casts else df


def with_event_id(df: DataFrame) -> DataFrame:
    """Add a tie-break made of the row's content where the source has none.

    Equal rows get equal ids, and swapping equal rows changes no result, so
    the order stays the same however often a lost task is run again.
    """
    if S.EVENT_ID in df.columns:
        return df
    return df.withColumn(S.EVENT_ID, F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]))


def read_events(spark: SparkSession, path, fmt: str = "csv", unreadable: str = "raise") -> DataFrame:
    """Raw or enriched events; all columns are kept, times lose their zone.

    A time, id or price that is there and cannot be read fails the job: as NULL its row would silently leave
    sessions and sums.  ``unreadable="null"`` takes such values as NULL.
    """
    known = T.StructType(S.EVENT.fields + S.DERIVED.fields)
    return with_event_id(_typed(_read(spark, path, fmt), known, unreadable))


def read_events_and_rejects(spark: SparkSession, path, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Events as ``read_events`` gives them, and the rows that it would fail on: as they came, with ``reasons``, an array of texts.

    One pass reads, casts and judges every row and is written; a row is in exactly one of the two results.
    """
    raw = with_event_id(_read(spark, path, fmt))
    casts, reasons = _casts(raw, T.StructType(S.EVENT.fields + S.DERIVED.fields))
    why = F.filter(F.array(*reasons.values()), lambda r: r.isNotNull()) if reasons else F.array().cast("array<string>")
    judged = raw.select(F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("raw"), why.alias("reasons"), *[casts.get(c, F.col(f"`{c}`")).alias(c) for c in raw.columns])
    judged = materialize(judged.withColumn("raw", F.when(F.size("reasons") > 0, F.col("raw"))), "events-judged")
    events = judged.filter(F.size("reasons") == 0).drop("raw", "reasons")
    return events, judged.filter(F.size("reasons") > 0).select("raw.*", "reasons")


def read_sessions(spark: SparkSession, path, fmt: str = "csv", unreadable: str = "raise") -> DataFrame:
    return _typed(_read(spark, path, fmt), S.SESSIONS, unreadable)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    """Write an event or session table; partition by ``set`` to let readers prune."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        # The default time format of CSV cuts microseconds.
        writer = writer.options(header=True, encoding="UTF-8", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    writer.format(fmt).save(path)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table where none are named: ``spark.sql.shuffle.partitions``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, keys=tuple(S.SESSION_KEY), buckets: int | None = None, placed: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Write a Parquet table bucketed by ``keys`` and give it back as ``read_bucketed`` does.

    Whatever groups, joins or orders its rows by ``keys`` needs no exchange, in this session and in later ones.  A bucket is one file and
    one task: name so many that it has a few hundred MB, up to ``spark.sql.sources.bucketing.maxBuckets`` (100,000).  Rows are dealt to their buckets by
    one exchange; ``placed`` says that they come from ``repartition(buckets, *keys)`` and steps that keep its partitions, so that none is needed.
    """
    spark, keys = df.sparkSession, list(keys)
    buckets = buckets or bucket_count(spark)
    # the layout goes with the key columns in the file footers
    marks = {k: F.col(k).alias(k, metadata={"bucket_key": i, "buckets": buckets}) for i, k in enumerate(keys)}
    dealt = df if placed else df.repartition(buckets, *keys)
    name = _new_name()
    dealt.select(*[marks[c] if c in marks else F.col(_quoted(c)) for c in df.columns]).write.mode(mode).bucketBy(buckets, *keys).saveAsTable(name, format="parquet", path=path)
    return _taken(spark, name)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` wrote, with its buckets; they are stated in its files, no catalog has to know it."""
    schema = spark.read.parquet(path).schema
    keys = sorted((f for f in schema if "bucket_key" in f.metadata), key=lambda f: f.metadata["bucket_key"])
    if not keys:
        raise ValueError(f"{path} is not bucketed")
    columns, by = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema), ", ".join(_quoted(f.name) for f in keys)
    name, location = _new_name(), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {keys[0].metadata['buckets']} BUCKETS LOCATION '{location}'")
    return _taken(spark, name)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _new_name() -> str:
    return f"clicktrail_{uuid.uuid4().hex}"


def _taken(spark: SparkSession, name: str) -> DataFrame:
    """The table as a DataFrame, and its name out of the catalog; files of a table with a path of its own stay."""
    table = spark.table(name)
    table.schema  # resolved while the catalog has it
    spark.sql(f"DROP TABLE {name}")
    return table


def cast_columns(df: DataFrame, types: dict) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})
