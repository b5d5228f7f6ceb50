import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parley import schema  # noqa: E402
from parley.session import tune  # noqa: E402

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture
def messages(spark):
    """Message tables from (conv_id, idx, dict) triples with defaults for everything else."""

    def build(rows):
        out = []
        for conv_id, idx, given in rows:
            row = {"conv_id": conv_id, "idx": idx, "msg_id": f"{conv_id}-{idx}",
                   "time": START + timedelta(seconds=given.get("at", 60 * idx)), "origin": "User", "content": "text",
                   "user_id": "u", "user_name": "U", "private": False, "votes": 0, "metadata": {}}
            row.update({k: v for k, v in given.items() if k != "at"})
            out.append(tuple(row[f.name] for f in schema.MESSAGE.fields))
        return spark.createDataFrame(out, schema.MESSAGE)

    return build


@pytest.fixture
def spans(spark):
    def build(rows):
        names = [f.name for f in schema.SPAN.fields]
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema.SPAN)

    return build
