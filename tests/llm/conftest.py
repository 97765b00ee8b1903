import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tools import CLASHING, COLUMNS, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, COLUMNS)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
