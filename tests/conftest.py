from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("NEARFIELD_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def rows(frame) -> list[tuple]:
    """A pandas frame's rows by column name, sorted, null as None and numbers as floats."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(([tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)]), key=str)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    def run(sql: str, folder: str):
        con = duckdb.connect()
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
                con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
        return con.execute(sql).df()

    return run
