from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from factloom.session import build_session

SMALL = "/root/testdata/sf0.001"


def make_session() -> SparkSession:
    spark = build_session(
        "factloom-tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
