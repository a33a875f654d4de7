"""A clickstream made of the driver's ``events`` and ``part`` tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.schemas import EVENT, MONEY


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Events without the product attributes, see ``FIXTURES.md`` for the mapping."""
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        "user_id",
        F.col("value").cast(MONEY).alias("price"),
        F.when(F.col("event_id") % 97 != 0, F.col("event_id").cast("string")).alias("user_session"),
    )


def with_products(df: DataFrame, folder: str) -> DataFrame:
    """Add category and brand of each event's product.

    ``part`` has no size hint: Catalyst broadcasts it below the threshold and
    otherwise sort-merge joins, where adaptive execution splits hot products.
    """
    key = F.col("p_partkey")
    parts = df.sparkSession.read.parquet(f"{folder}/part.parquet").select(
        key.alias("product_id"),
        F.col("p_size").cast("bigint").alias("category_id"),
        F.when(
            key % 7 != 0, F.lower(F.concat_ws(".", "p_type", F.replace("p_name", F.lit(" "), F.lit("."))))
        ).alias("category_code"),
        F.when(key % 5 != 0, F.col("p_brand")).alias("brand"),
    )
    return df.join(parts, "product_id", "left").select(*EVENT.names, *[c for c in df.columns if c not in EVENT.names])


def clickstream(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the raw event schema."""
    return with_products(clicks(spark, folder), folder)
