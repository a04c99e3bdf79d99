import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import tests  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lorekeep import get_session

    session = get_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    # Model stand-ins of the tests travel to the workers like the package does.
    cloudpickle.register_pickle_by_value(tests)
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column over one row: value(col, x="...") -> Python value."""
    from pyspark.sql import functions as F

    def run(column, **fields):
        row = spark.range(1).select(
            *[F.lit(v).cast("string" if v is None or isinstance(v, str) else "int").alias(k) for k, v in fields.items()]
        )
        return row.select(column.alias("out")).head().out

    return run
