"""The folder that the driver and all executors share: tables that cut lineage, and files."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, deleted when the application ends. Where that is unset and
    everything runs on one machine, as in tests, a temporary folder becomes the checkpoint folder; on a cluster it is an
    error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(base)
    found = f"{base.rstrip('/')}/nearfield-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives the executors that made it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def put(path: str, data: bytes) -> None:
    """Writes a file under another name and then moves it, so that a lost or repeated task leaves no half file."""
    where, name = opened(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(part := f"{name}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    where.move(part, name)


def get(path: str) -> bytes:
    where, name = opened(path)
    with where.open_input_stream(name) as data:
        return data.read()
