"""Contiguous shards of nearly equal bytes from a parallel prefix sum."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table
from clicktrail.spark import materialize

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
SHARDS = 40


def shard(docs: DataFrame, shards: int = SHARDS, own=None) -> DataFrame:
    """Cut the documents, ordered by ``doc_id``, into ``shards`` runs of nearly equal bytes.

    Texts never move: only id, size and checksum are range partitioned and written once.  The byte totals of the
    partitions (one row each) give every partition its global offset; inside a partition a running sum goes on from
    there.  A document belongs to the shard whose target range holds its middle byte, so no shard is further from
    the target than one document.

    A null text has size 16 and a null checksum; null ids come first; equal ids go by checksum, then size; repeated
    rows each get a slot of their own; an empty table gives an empty result.  Further columns are ignored.
    ``law`` is always ``bytes`` and ``grown_shard`` null: with one more shard the cuts move.  Very long texts are one row of their size.

    ``own``, a column that tells rows apart, is the last criterion of order and comes back beside the others.
    """
    order = ["doc_id", "text_crc32", "size"] + ["own"] * (own is not None)
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32("text").alias("text_crc32"), *([] if own is None else [own.alias("own")]),
    )
    rows = materialize(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-rows")

    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.join(parts, "part")
        .withColumn("before", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"CAST(least({shards - 1}, (2 * before + size) * {shards} DIV (2 * total)) AS INT)"))
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *order[3:],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents into one folder per shard, in slot order within a file; return the assignment.

    Rows are numbered and written first, so that each goes to its own slot once, whatever ids it shares.  The folder's column ``shard`` takes the
    place of one of that name.
    """
    record = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "shard"]).alias("record")
    rows = materialize(docs.select(record, F.monotonically_increasing_id().alias("own")), "shard-texts")
    placed = materialize(shard(rows.select("record.doc_id", "record.text", "own"), shards, F.col("own")), "shards")
    (
        rows.join(placed.select("own", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "own")
        .repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
        .select("record.*", F.col("__shard").alias("shard"))
        .write.partitionBy("shard").parquet(path)
    )
    return placed.drop("own")


@query("op1_sharding")
def op1(spark, folder):
    return shard(table(spark, folder, "documents"))
