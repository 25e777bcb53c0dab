import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hitscope.session import configure  # noqa: E402

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("seq bigint, ts timestamp, ip string, method string, path string, status int, bytes_sent bigint, "
          "response_time double, user_agent string, country string, handler string, referer string")
DEFAULTS = {"method": "GET", "path": "/", "status": 200, "bytes_sent": 100, "response_time": 0.1, "user_agent": "x",
            "country": "NL", "handler": "", "referer": "", "ip": "1.1.1.1"}


@pytest.fixture(scope="session")
def spark():
    session = configure(SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
                        .config("spark.driver.memory", "4g"), 4).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Builds an access log from dicts; ``at`` is seconds after T0, ``seq`` the list position."""
    def build(rows, partitions=3):
        full = []
        for i, row in enumerate(rows):
            row = {**DEFAULTS, "seq": i, **row}
            row["ts"] = T0 + dt.timedelta(seconds=row.pop("at", i))
            full.append(tuple(row[c.split()[0]] for c in SCHEMA.split(", ")))
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return build
