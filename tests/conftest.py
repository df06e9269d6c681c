import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


def session():
    from pyspark.sql import SparkSession

    from ledgerloom.runtime import ship

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


SESSION = session()  # test modules make expressions when they are imported, which needs one


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


def column(spark, values, expression, kind="string"):
    """Results of an expression over a column ``x`` of values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expression.alias("y"), "i").orderBy("i").collect()]
