"""Sends this package to the executors, which share no folder with the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


#: Texts and vectors make large rows: Arrow batches of this size at most, where the session leaves Spark's default.
BATCH, DEFAULT = "16m", "67108864b"
_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package, through Spark's own file server. And smaller Arrow batches."""
    if spark.conf.get(_SIZE, None) == DEFAULT:
        spark.conf.set(_SIZE, BATCH)
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here, folder = Path(__file__).parent, Path(tempfile.mkdtemp(prefix="nearfield-ship-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that start later fetch it too
    with zipfile.ZipFile(folder / "nearfield.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(folder.resolve() / "nearfield.zip"))
    _SENT.add(app)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, where the function may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
