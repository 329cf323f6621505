"""Commands over tables and vector files: python -m nearfield <command> --help."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synthetic
from .api import IndexSpec, VectorIndex
from .operators import cluster, evaluate, knn, labels, quantize, vamana
from .sources import vector_files as files


def _points(spark: SparkSession, args) -> DataFrame:
    """A binary matrix, a per-row file, text or a Parquet table, by the path's ending; labels from a file of lines."""
    path, kind = args.data, getattr(args, "kind", "float")
    ending = path.rstrip("/").rsplit(".", 1)[-1]
    if ending in ("fvecs", "bvecs", "ivecs"):
        df = files.read_rows(spark, path, {"fvecs": "float", "bvecs": "uint8", "ivecs": "uint32"}[ending])
    elif ending in ("tsv", "txt"):
        df = files.read_tsv(spark, path)
    elif ending == "bin":
        df = files.read_bin(spark, path, kind)
    else:
        df = spark.read.parquet(path)
    if getattr(args, "labels", None):
        own = files.lines(spark, args.labels).select(F.col("line").alias("vec_id"), labels.parse(F.col("value")).alias("labels"))
        df = df.drop("labels").join(own, "vec_id", "left")
    return df


def _queries(spark: SparkSession, args) -> DataFrame:
    q = _points(spark, argparse.Namespace(data=args.queries, kind=args.kind)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    if args.filter and args.filter_file:
        raise ValueError("a filter and a file of filters exclude each other")
    if args.filter:
        q = q.withColumn("wanted", F.lit(args.filter))
    if args.filter_file:
        q = q.join(files.read_filters(spark, args.filter_file, queries=q.count()), "qid")
    return q


def build(spark, args) -> None:
    df = _points(spark, args)
    dim = df.select(F.max(F.size("embedding"))).first()[0] or 0
    spec = IndexSpec(dim, args.metric, args.degree, args.width, args.shard_rows, args.copies, labelled=bool(args.labels), universal=args.universal)
    VectorIndex.build(df, spec).save(args.index)
    print(json.dumps({"index": args.index, "points": df.count(), "dim": dim}))


def search(spark, args) -> None:
    """A line for each width: seconds, queries a second and, with a truth file, the recall."""
    index, q = VectorIndex.load(spark, args.index), _queries(spark, args).cache()
    n, found = q.count(), None
    for width in args.widths:
        began = time.time()
        rows = index.search(q, args.k, width, args.beam, fast=args.fast).withColumn("width", F.lit(width)).cache()
        rows.count()
        took = time.time() - began
        line = {"width": width, "seconds": round(took, 3), "queries_a_second": round(n / took, 2)}
        if args.truth:
            line["recall"] = evaluate.recall(files.read_truth(spark, args.truth), rows, args.k, args.metric == "ip").agg(F.avg("recall")).first()[0]
        print(json.dumps(line), flush=True)
        found = rows if found is None else found.unionByName(rows)
    if args.out:
        files.write_results(found.where(F.col("width") == args.widths[-1]), args.out)
    if args.matrices:
        files.write_result_matrices(found, args.matrices, args.k)
    if args.least_recall is not None:
        if not args.truth:
            raise ValueError("a recall needs a truth file")
        evaluate.gate(evaluate.recall(files.read_truth(spark, args.truth), found.where(F.col("width") == args.widths[-1]), args.k, args.metric == "ip"), args.least_recall)


def within(spark, args) -> None:
    index = VectorIndex.load(spark, args.index)
    files.write_results(index.within(_queries(spark, args), args.radius, exact=args.exact), args.out)


def insert(spark, args) -> None:
    index = VectorIndex.load(spark, args.index)
    rejected = index.insert(_points(spark, args))
    index.save(args.out)
    print(json.dumps({"rejected": rejected.count()}))


def delete(spark, args) -> None:
    index = VectorIndex.load(spark, args.index)
    failed = index.delete(files.lines(spark, args.ids).where("value <> ''").select(F.col("value").cast("bigint").alias("vec_id")))
    report = index.consolidate().first().asDict() if args.consolidate else {}
    index.save(args.out)
    print(json.dumps({"failed": failed.count()} | report))


def truth(spark, args) -> None:
    df, q = _points(spark, args), _queries(spark, args)
    if args.radius is not None:
        files.write_range_truth(knn.nearest(df, q, 1, args.metric, within=args.radius), args.out, q)
    else:
        files.write_truth(knn.nearest(df, q, args.k, args.metric), args.out, args.k)


def stats(spark, args) -> None:
    index = VectorIndex.load(spark, args.index)
    print(json.dumps(index.status().first().asDict()))


def convert(spark, args) -> None:
    df, ending = _points(spark, args), args.out.rstrip("/").rsplit(".", 1)[-1]
    if ending in ("fvecs", "bvecs", "ivecs"):
        files.write_rows(df, args.out, {"fvecs": "float", "bvecs": "uint8", "ivecs": "uint32"}[ending])
    elif ending == "bin":
        files.write_bin(df, args.out, args.kind)
    elif ending in ("tsv", "txt"):
        files.write_tsv(df, args.out)
    else:
        df.write.parquet(args.out)


def generate(spark, args) -> None:
    df = synthetic.vectors(spark, args.n, args.dim, args.kind, args.norm, seed=args.seed)
    if args.label_count:
        df = df.join(synthetic.labels(spark, args.n, args.label_count, args.label_kind, args.seed), "vec_id")
    df.write.parquet(args.out) if not args.out.endswith(".bin") else files.write_bin(df, args.out, args.kind)


def sample(spark, args) -> None:
    cluster.drawn(_points(spark, args), args.share, seed=args.seed).write.parquet(args.out)


def partition(spark, args) -> None:
    df = _points(spark, args)
    if args.budget is not None:
        homes = cluster.shards_within(df, args.budget, df.select(F.max(F.size("embedding"))).first()[0] or 0, copies=args.copies)
    else:
        homes = cluster.partition(df, args.parts, args.copies)
    homes.write.parquet(args.out)


def codes(spark, args) -> None:
    df = _points(spark, args)
    quantize.encode(df, quantize.train(df, args.chunks, args.codes, rotate=args.rotate)).write.parquet(args.out)


def stitch(spark, args) -> None:
    vamana.stitched(_points(spark, args), args.degree, args.width, args.stitched_degree, metric=args.metric).write.parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearfield", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(function, *options: str) -> argparse.ArgumentParser:
        one = sub.add_parser(function.__name__, help=function.__doc__)
        one.set_defaults(run=function)
        for name in options:
            one.add_argument(f"--{name}", required=True)
        one.add_argument("--kind", default="float", choices=sorted(files.TYPES))
        one.add_argument("--metric", default="l2", choices=("l2", "l1", "cosine", "ip"))
        return one

    def queries(one: argparse.ArgumentParser) -> argparse.ArgumentParser:
        one.add_argument("--queries", required=True)
        one.add_argument("--filter")
        one.add_argument("--filter-file")
        return one

    one = command(build, "data", "index")
    for name, value in (("degree", 32), ("width", 64), ("shard-rows", vamana.SHARD_ROWS), ("copies", 2)):
        one.add_argument(f"--{name}", type=int, default=value)
    one.add_argument("--labels")
    one.add_argument("--universal")
    one = queries(command(search, "index"))
    one.add_argument("--k", type=int, default=10)
    one.add_argument("--widths", type=int, nargs="+", default=[50])
    one.add_argument("--beam", type=int, default=1)
    one.add_argument("--fast", action="store_true")
    one.add_argument("--truth")
    one.add_argument("--out")
    one.add_argument("--matrices")
    one.add_argument("--least-recall", type=float)
    one = queries(command(within, "index", "out"))
    one.add_argument("--radius", type=float, required=True)
    one.add_argument("--exact", action="store_true")
    command(insert, "index", "data", "out").add_argument("--labels")
    command(delete, "index", "ids", "out").add_argument("--consolidate", action="store_true")
    one = queries(command(truth, "data", "out"))
    one.add_argument("--k", type=int, default=100)
    one.add_argument("--radius", type=float)
    command(stats, "index")
    command(convert, "data", "out")
    one = command(generate, "out")
    for name, kind, value in (("n", int, 1000), ("dim", int, 64), ("norm", float, None), ("seed", int, 42), ("label-count", int, 0), ("label-kind", str, "zipf")):
        one.add_argument(f"--{name}", type=kind, default=value)
    one = command(sample, "data", "out")
    one.add_argument("--share", type=float, required=True)
    one.add_argument("--seed", type=int, default=0)
    one = command(partition, "data", "out")
    for name, kind, value in (("parts", int, 3), ("copies", int, 2), ("budget", float, None)):
        one.add_argument(f"--{name}", type=kind, default=value)
    one = command(codes, "data", "out")
    for name, value in (("chunks", 16), ("codes", 256), ("rotate", 0)):
        one.add_argument(f"--{name}", type=int, default=value)
    one = command(stitch, "data", "out")
    one.add_argument("--labels")
    for name, value in (("degree", 32), ("width", 64), ("stitched-degree", 64)):
        one.add_argument(f"--{name}", type=int, default=value)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 for a request that cannot be met."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        args.run(spark, args)
    except ValueError as e:
        print(f"nearfield: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
