"""A sliding window by arrival count, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(most: int, window: int, interval: int) -> None:
    """The limits under which a window can slide."""
    if window + interval > most:
        raise ValueError("the index must hold a window and an interval")
    if interval < most / 1000:
        raise ValueError("the interval must be a thousandth of the index at least")


def active(ops: DataFrame, window: int, interval: int, most: int | None = None) -> DataFrame:
    """ops: seq (0, 1, ...) and vec_id. The rows that are live after the last whole interval: the newest
    window rows of those that whole intervals have inserted. most: what the index holds, a window and an interval
    unless given."""
    check(window + interval if most is None else most, window, interval)
    n = ops.agg(F.count("*").alias("n"))
    done = F.when(F.col("n") < window, F.col("n")).otherwise(F.floor((F.col("n") - window) / interval) * interval + window)
    return ops.join(F.broadcast(n)).where((F.col("seq") < done) & (F.col("seq") >= F.greatest(done - window, F.lit(0)))).drop("n")


def apply_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Applies batches of (op, vec_id, embedding, seq) to the table in the folder: each batch writes a new
    version, in which an id has its last operation. Readers take the newest version (see current)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, folder, number)
        rows = batch.select("op", "vec_id", "embedding", "seq")
        rows = rows if old is None else old.select(F.lit("insert").alias("op"), "vec_id", "embedding", "seq").unionByName(rows)
        last = rows.groupBy("vec_id").agg(F.max_by(F.struct("op", "embedding"), "seq").alias("x"), F.max("seq").alias("seq"))
        last.where("x.op <> 'delete'").select("vec_id", "x.embedding", "seq").write.mode("overwrite").parquet(f"{folder}/v{number:010d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in (files.listStatus(path) if files.exists(path) else []))
    done = [n for n in names if n[:1] == "v" and (before is None or int(n[1:]) < before) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{folder}/{done[-1]}") if done else None
