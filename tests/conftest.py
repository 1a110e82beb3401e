from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)
# Python workers import the library by name.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    spark = session("8")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield spark
    spark.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a DDL schema; timestamps may be given as text."""

    def make(rows, schema: str):
        text = schema.replace("timestamp_ntz", "string")
        df = spark.createDataFrame(rows, text)
        for column in schema.split(","):
            if column.endswith(" timestamp_ntz"):
                name = column.removesuffix(" timestamp_ntz").strip()
                df = df.withColumn(name, df[name].cast("timestamp_ntz"))
        return df

    return make
