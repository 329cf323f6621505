"""A live index that a stream of inserts and deletes changes, batch by batch.

Each batch makes a new version in the folder: deletes are marked, new points are linked, and every so many batches the
deleted ones are taken out of the graph. Readers take the newest whole version, so they see a batch or none of it; a batch
that is repeated after a failure writes its version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api import IndexSpec, VectorIndex


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are whole: their meta.json is written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in (files.listStatus(path) if files.exists(path) else [])]
    whole = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/meta.json"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and whole(n))


def newest(spark: SparkSession, folder: str, before: int | None = None) -> VectorIndex | None:
    """The newest version, or the newest before a number."""
    found = [v for v in versions(spark, folder) if before is None or v < before]
    return VectorIndex.load(spark, f"{folder}/v{found[-1]:010d}") if found else None


def change(index: VectorIndex | None, batch: DataFrame, spec: IndexSpec, consolidate: bool) -> VectorIndex | None:
    """batch: op (insert or delete), vec_id, embedding, labels if the index has them, seq. An id's last operation in
    the batch holds; an insert of an id that is there replaces it."""
    last = batch.where("vec_id IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("seq")))).where("place = 1")
    new = last.where("op = 'insert'").drop("op", "seq", "place")
    if index is None:
        return None if new.isEmpty() else VectorIndex.build(new, spec)
    index.delete(last.select("vec_id"))
    taken = new.join(index.nodes.select("vec_id"), "vec_id", "left_semi")
    if consolidate or not taken.isEmpty():  # an id's old vector must be gone before the new one comes
        index.consolidate()
    if not new.isEmpty():
        index.insert(new)
    return index


def apply_stream(stream: DataFrame, folder: str, checkpoint: str, spec: IndexSpec, consolidate_every: int = 10):
    """Changes the index in the folder by a stream of operations, see change."""

    def step(batch: DataFrame, number: int) -> None:
        changed = change(newest(batch.sparkSession, folder, number), batch, spec, number % consolidate_every == consolidate_every - 1)
        if changed is not None:
            changed.save(f"{folder}/v{number:010d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
