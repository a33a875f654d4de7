import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clicktrail.spark import session as spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = spark_session(
        "local[8]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def events(spark):
    """Make an event table from ``(user, time, type, product, price, category, brand)``, shorter rows are filled."""

    def make(rows, shuffle=False):
        full = []
        for i, row in enumerate(rows):
            user, time, kind, *rest = row
            product, price, category, brand = [*rest, *[1, "1.00", "a.b.c", "x"][len(rest):]]
            full.append((time, kind, product, 7, category, brand, price, user, "s", i))
        if shuffle:
            full = full[::-1]
        return spark.createDataFrame(
            full,
            "event_time string, event_type string, product_id long, category_id long, category_code string, "
            "brand string, price string, user_id long, user_session string, event_id long",
        ).selectExpr(
            "CAST(event_time AS timestamp_ntz) AS event_time", "event_type", "product_id", "category_id", "category_code",
            "brand", "CAST(price AS decimal(12,2)) AS price", "user_id", "user_session", "event_id",
        )

    return make
