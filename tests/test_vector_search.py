"""Properties, edge cases and approximate operators."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.api import BuildError, IndexSpec, SearchError, VectorIndex, answer, error_code, register
from nearfield.functions import vectors as V
from nearfield.operators import cluster, knn, proximity, quantize, vamana
from nearfield.sources import vector_files as files
from nearfield.streaming import live_index, window


def points(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "vec_id bigint, embedding array<float>")


def queries(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "qid bigint, q array<float>")


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [("l2sq", [1, 2], [4, 6], 25), ("l2", [1, 2], [4, 6], 5), ("l1", [1, 2], [4, 6], 7), ("cosine", [1, 0], [0, 1], 1), ("cosine", [0, 0], [0, 1], 1), ("l2", [1], [1, 2], float("inf")), ("ip_distance", [], [], 0), ("dot", [1, 2], [3, 4], 11), ("l1", None, [1], None)],
)
def test_distances(spark, name, a, b, want):
    floats = lambda v: v and [float(x) for x in v]
    df = spark.createDataFrame([(floats(a), floats(b))], "a array<float>, b array<float>")
    got = df.select(getattr(V, name)(F.col("a"), F.col("b"))).first()[0]
    assert got == want if want is None else got == pytest.approx(want)


def plain_prune(pool, far, vectors, degree, alphas=(1.0, 1.2)):
    """One candidate after another, l2."""
    worst, out = [0.0] * len(pool), []
    for alpha in alphas:
        for i in range(len(pool)):
            if len(out) >= degree or worst[i] > alpha:
                continue
            worst[i] = float("inf")
            out.append(pool[i])
            for t in range(i + 1, len(pool)):
                djk = ((vectors[pool[i]] - vectors[pool[t]]) ** 2).sum()
                worst[t] = max(worst[t], float("inf") if djk == 0 else far[t] / djk)
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 8))
def test_prune_against_a_plain_one(seed, n, degree):
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.normal(size=(n + 1, 3)), 1)  # with repeats
    far = ((vectors[:-1] - vectors[-1]) ** 2).sum(1)
    order = np.lexsort((np.arange(n), far))
    got = proximity.prune(order[None], far[order][None], vectors, degree)[0]
    assert got[got >= 0].tolist() == plain_prune(order.tolist(), far[order].tolist(), vectors, degree)
    full = proximity.prune(order[None], far[order][None], vectors, degree, fill=True)[0]
    assert (full >= 0).sum() == min(n, degree) and len(set(full[full >= 0].tolist())) == min(n, degree)
    once = proximity.prune_once(order, far[order], vectors, degree)
    left, want = order.tolist(), []
    while left and len(want) < degree:
        want.append(left.pop(0))
        left = [t for t in left if far[t] < 1.2 * ((vectors[t] - vectors[want[-1]]) ** 2).sum()]
    assert once == want


def test_prune_of_inner_products_and_labels():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, degree = int(rng.integers(1, 25)), int(rng.integers(1, 7))
        vectors = rng.normal(size=(n + 1, 4))
        far = -(vectors[:-1] @ vectors[-1])
        order = np.lexsort((np.arange(n), far))
        worst, want = np.zeros(n), []
        for alpha in (1.0, 1.2):
            for i in range(n):
                if len(want) >= degree or worst[i] > alpha:
                    continue
                worst[i] = np.inf
                want.append(int(order[i]))
                for t in range(i + 1, n):
                    if vectors[order[i]] @ vectors[order[t]] > alpha * -far[order[t]]:
                        worst[t] = max(worst[t], alpha + 0.01)
        got = proximity.prune(order[None], far[order][None], vectors, degree, "ip")[0]
        assert got[got >= 0].tolist() == want
        labels = rng.random((n, 3)) < 0.6
        far2 = ((vectors[:-1] - vectors[-1]) ** 2).sum(1)
        order = np.lexsort((np.arange(n), far2))
        own = labels[order]
        covers = ~((~own[:, None] & own[None]).any(-1))
        worst, want = np.zeros(n), []
        for alpha in (1.0, 1.2):
            for i in range(n):
                if len(want) >= degree or worst[i] > alpha:
                    continue
                worst[i] = np.inf
                want.append(int(order[i]))
                for t in range(i + 1, n):
                    if not (own[t] & ~own[i]).any():
                        worst[t] = max(worst[t], far2[order[t]] / ((vectors[order[i]] - vectors[order[t]]) ** 2).sum())
        got = proximity.prune(order[None], far2[order][None], vectors, degree, covers=covers[None])[0]
        assert got[got >= 0].tolist() == want


def plain_walk(graph, vectors, q, starts, width, beam=1, allowed=None):
    best, seen, done = [], set(), set()
    d = lambda p: ((vectors[p] - q) ** 2).sum()

    def offer(ps):
        for p in ps:
            if p >= 0 and p not in seen and (allowed is None or allowed[p]):
                seen.add(p)
                best.append((d(p), p))
        best.sort()
        del best[width:]

    offer(starts)
    while now := [p for _, p in best if p not in done][:beam]:
        done.update(now)
        offer([x for p in now for x in graph[p].tolist()])
    return [p for _, p in best], len(done), len(seen)


def test_walk_against_a_plain_one():
    rng = np.random.default_rng(5)
    for seed in range(25):
        n = int(rng.integers(2, 80))
        vectors, graph = rng.normal(size=(n, 4)), rng.integers(-1, n, (n, 6)).astype(np.int32)
        q, width, beam = rng.normal(size=(7, 4)), int(rng.integers(1, 15)), int(rng.integers(1, 4))
        allowed = rng.random((7, n)) < 0.8 if seed % 2 else None
        starts = rng.integers(0, n, (7, 2))
        got = proximity.walk(graph, vectors, q, starts, width, beam=beam, allowed=allowed)
        for i in range(7):
            want, hops, met = plain_walk(graph, vectors, q[i], starts[i], width, beam, None if allowed is None else allowed[i])
            found = got.positions[i]
            assert (found[found >= 0].tolist(), got.hops[i], got.compared[i]) == (want, hops, met)


def test_ties_nulls_and_large_k(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "vec_id bigint, embedding array<float>")
    got = knn.nearest(base, queries(spark, [[0.5, 0.5]]), 10).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(0, 0.5), (1, 0.5)]
    assert knn.nearest(base, queries(spark, [[0.5, 0.5]]).where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(base, queries(spark, [[0.5, 0.5]]), 0)


def test_every_length_meets_its_queries(spark):
    base = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0]), (3, [1.0, 1.0]), (4, []), (5, None)], "vec_id bigint, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0]), (2, None), (3, [])], "qid bigint, q array<float>")
    for most in (1 << 25, 1):
        got = knn.nearest(base, asked, 2, most=most).orderBy("qid", "rank").collect()
        assert [(r.qid, r.vec_id, r.distance) for r in got] == [(0, 3, 2.0), (1, 0, 1.0), (1, 1, 4.0), (3, 4, 0.0)]


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "ip"])
def test_blocks_give_the_same_rows(spark, metric):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 6)), 1)
    base, asked = points(spark, x), queries(spark, x[::7])
    rows = lambda df: sorted((r.qid, r["rank"], r.vec_id, r.distance) for r in df.collect())
    assert rows(knn.nearest(base, asked, 5, metric, skip_self=True)) == rows(knn.nearest(base, asked, 5, metric, skip_self=True, most=60))
    near = 0.5 if metric == "ip" else 3.0
    assert rows(knn.nearest(base, asked, 1, metric, within=near)) == rows(knn.nearest(base, asked, 1, metric, within=near, most=60))
    both = knn.against(base, asked, 60)
    assert both.count() == 300 * 43 and both.select("vec_id", "qid").distinct().count() == 300 * 43
    parts = [knn.nearest(base.where(F.col("vec_id") % 3 == i), asked, 5, metric) for i in range(3)]
    merged = knn.best_of(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5, descending=metric == "ip")
    assert rows(merged) == rows(knn.nearest(base, asked, 5, metric))


def share(found, exact) -> float:
    exact = {(r.qid, r.vec_id) for r in exact.collect()}
    return len(exact & {(r.qid, r.vec_id) for r in found.collect()}) / len(exact)


def test_graph_recall_and_shape(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(-1, 1, (600, 16))
    base, q = points(spark, x), queries(spark, rng.uniform(-1, 1, (20, 16)))
    exact = knn.nearest(base, q, 10).cache()
    for rows, copies in ((5000, 1), (250, 2), (90, 3)):
        nodes = vamana.build(base, degree=24, width=48, shard_rows=rows, copies=copies).cache()
        shards = nodes.groupBy("shard").count().agg(F.max("count"), F.count("*")).first()
        assert shards[0] <= 1.5 * rows and (shards[1] > 1) == (rows < 600)
        assert nodes.select(F.max(F.size("neighbours"))).first()[0] <= 24
        edges = vamana.edges(nodes, 24)
        assert edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 24 and edges.where("src = dst").isEmpty()
        recalls = [share(vamana.search(nodes, q, 10, width), exact) for width in (10, 30, 100)]
        assert recalls[2] >= 0.95 and recalls[0] <= recalls[2] + 0.02
        assert vamana.search(nodes, q, 10, 100, beam=8).count() == 200
        nodes.unpersist()
    with pytest.raises(ValueError):
        vamana.search(nodes, q, 10, 5)
    with pytest.raises(ValueError):
        vamana.search(nodes, q, 1, 5, beam=0)


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine", "ip"])
def test_index_keeps_its_metric(spark, metric):
    x = np.random.default_rng(7).normal(size=(400, 8)) * np.linspace(0.1, 3, 400)[:, None]
    index = VectorIndex.build(points(spark, x), IndexSpec(dim=8, metric=metric, degree=16, build_width=32, shard_rows=300))
    q = queries(spark, x[:12] + 0.1)
    exact = {(r.qid, r["rank"]): (r.vec_id, r.distance) for r in index.exact(q, 5).collect()}
    found = {(r.qid, r["rank"]): (r.vec_id, r.distance) for r in index.search(q, 5, 60).collect()}
    assert np.mean([found[k][0] == v[0] for k, v in exact.items()]) >= 0.9
    assert all(found[k][1] == pytest.approx(v[1]) for k, v in exact.items() if found[k][0] == v[0])
    small = VectorIndex.build(spark.createDataFrame([(1, [10.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.9])], "vec_id bigint, embedding array<float>"), IndexSpec(dim=2, metric=metric))
    one = queries(spark, [[1.0, 0.0]])
    assert small.search(one, 1, 5).first().vec_id == small.exact(one, 1).first().vec_id


def labelled(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    labels = [[str(i % 5)] + (["rare"] if i % 41 == 0 else []) + (["U"] if i % 60 == 0 else []) for i in range(n)]
    return x, labels, spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(n)], "vec_id bigint, embedding array<float>, labels array<string>")


def test_filtered_search_recall_by_label(spark):
    x, labels, base = labelled(spark)
    index = VectorIndex.build(base, IndexSpec(dim=8, degree=24, build_width=48, shard_rows=300, labelled=True, universal="U"))
    for wanted in ("0", "3", "rare"):
        q = queries(spark, x[:20] + 0.05).withColumn("wanted", F.lit(wanted))
        match = base.where(F.array_contains("labels", wanted) | F.array_contains("labels", "U"))
        found = index.search(q, 5, 50).cache()
        assert share(found, knn.nearest(match, q, 5)) >= 0.9, wanted
        assert found.join(match, "vec_id", "left_anti").isEmpty()
    two = queries(spark, x[:20]).withColumn("wanted", F.array(F.lit("1"), F.lit("2")))
    match = base.where(F.arrays_overlap("labels", F.array(F.lit("1"), F.lit("2"), F.lit("U"))))
    assert share(index.search(two, 5, 60), knn.nearest(match, two, 5)) >= 0.9
    assert index.search(queries(spark, x[:2]).withColumn("wanted", F.lit("none")), 3, 20).count() > 0  # the universal label answers
    plain = VectorIndex.build(base, IndexSpec(dim=8, degree=16, build_width=24, labelled=True))
    with pytest.raises(ValueError, match="none"):
        plain.search(queries(spark, x[:2]).withColumn("wanted", F.lit("none")), 3, 20)


def test_stitched_and_label_graphs(spark):
    x, labels, base = labelled(spark, 300)
    own = vamana.per_label(base, degree=12, width=24, rows=40).cache()
    members = {(n, i) for i, ls in enumerate(labels) for n in ls}
    assert {(r.label, r.vec_id) for r in own.select("label", "vec_id").collect()} == members
    assert own.groupBy("shard").agg(F.countDistinct("label").alias("n")).agg(F.max("n")).first()[0] == 1
    pairs = vamana.stitched(base, degree=12, width=24, stitched_degree=16, rows=40).cache()
    assert pairs.groupBy("src").count().agg(F.max("count")).first()[0] <= 16 and pairs.where("src = dst").isEmpty()
    assert pairs.count() == pairs.distinct().count()
    united = {(r.src, r.dst) for r in vamana.edges(own).collect()}
    got = {}
    for r in pairs.collect():
        assert (r.src, r.dst) in united
        got.setdefault(r.src, set()).add(r.dst)
    pools = {}
    for a, b in united:
        pools.setdefault(a, []).append(b)
    v = np.array([[np.float32(c) for c in row] for row in x], float)
    for src, pool in pools.items():
        far = sorted((((v[src] - v[b]) ** 2).sum(), b) for b in pool)
        assert got[src] == (set(pool) if len(pool) <= 16 else set(plain_prune([b for _, b in far], [f for f, _ in far], v, 16)))


def test_inserts_and_deletes_on_a_live_index(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 8))
    every = points(spark, x)
    index = VectorIndex.build(every.where("vec_id < 300"), IndexSpec(dim=8, degree=20, build_width=40, shard_rows=200))
    odd = spark.createDataFrame([(5, [0.0] * 8), (900, [1.0]), (901, None)], "vec_id bigint, embedding array<float>")
    rejected = index.insert(every.where("vec_id >= 300").unionByName(odd))
    assert sorted(r.vec_id for r in rejected.collect()) == [5, 900, 901]
    q = queries(spark, rng.normal(size=(20, 8)))
    assert index.points.count() == 500 and share(index.search(q, 10, 60), knn.nearest(every, q, 10)) >= 0.9
    failed = index.delete(every.where("vec_id % 3 = 0").select("vec_id").unionByName(spark.createDataFrame([(7000,)], "vec_id bigint")))
    assert [r.vec_id for r in failed.collect()] == [7000]
    live = every.where("vec_id % 3 <> 0")
    for _ in range(2):  # before and after they are taken out
        assert share(index.search(q, 10, 80), knn.nearest(live, q, 10)) >= 0.9
        assert index.search(q, 10, 80).where("vec_id % 3 = 0").isEmpty()
        report = index.consolidate().first()
    assert (report.points, report.deleted, report.live) == (333, 0, 333)
    assert index.nodes.where("vec_id % 3 = 0").isEmpty() and index.edges.where("dst % 3 = 0").isEmpty()
    assert index.nodes.select(F.max(F.size("neighbours"))).first()[0] <= 26
    index.save(f"{tmp_path}/index")
    again = VectorIndex.load(spark, f"{tmp_path}/index")
    assert again.spec == index.spec and sorted(map(tuple, again.search(q, 5, 40).collect())) == sorted(map(tuple, index.search(q, 5, 40).collect()))
    extra = spark.read.parquet(f"{tmp_path}/index/nodes").limit(1).withColumn("vec_id", F.lit(-9).cast("bigint"))
    extra.write.mode("append").parquet(f"{tmp_path}/index/nodes")
    with pytest.raises(ValueError):
        VectorIndex.load(spark, f"{tmp_path}/index")


def test_kinds_of_search(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 16))
    base, q = points(spark, x), queries(spark, rng.normal(size=(15, 16)))
    nodes = vamana.build(base, degree=24, width=48, shard_rows=400, frozen=2).cache()
    assert nodes.where("hidden").count() == 2 * nodes.select("shard").distinct().count()
    exact = knn.nearest(base, q, 10).cache()
    assert vamana.search(nodes, q, 10, 80).where("vec_id < 0").isEmpty()
    for more in ({}, {"nearest_start": True}, {"fast": True}, {"beam": 4}):
        assert share(vamana.search(nodes, q, 10, 80, **more), exact) >= 0.9, more
    quantizer = quantize.train(base, 8, 32)
    codes = quantize.encode(base, quantizer)
    nodes = vamana.build(base, degree=24, width=48, shard_rows=400).cache()
    assert share(vamana.search_codes(nodes, q, codes, quantizer, 10, 150), exact) >= 0.9
    assert share(vamana.search_codes(nodes, q, codes, quantizer, 10, 100, most_reads=5), exact) < 0.9
    assert share(vamana.search_codes(nodes, q, codes, quantizer, 10, 100, rerank=30), exact) >= 0.6
    near = knn.nearest(base, q, 1, within=14.0)
    found = vamana.within(nodes, q, 14.0)
    assert share(found, near) >= 0.9 and found.where("distance > 14").isEmpty()
    curve = vamana.sweep(nodes, q, knn.nearest(base, q, 20), 10, [10, 40, 100]).orderBy("width").collect()
    assert [r.width for r in curve] == [10, 40, 100] and curve[0].mean_compared < curve[2].mean_compared and curve[2].recall >= 95
    top = vamana.visits(nodes, q, 40, 30).collect()
    assert len(top) == 30 and top[0].n >= top[-1].n
    rates = {2: 10.0, 3: 12.0, 4: 15.0, 5: 14.0}
    assert vamana.tune_beam(lambda beam: (rates[beam], 1.0, 1.0)) == 4
    assert vamana.tune_beam(lambda beam: (beam, beam, 1.0), slowest=4.0) == 5
    assert vamana.tune_beam(lambda beam: (beam, 0.0, 0.0)) == 60


def test_quantiser(spark):
    assert quantize.chunk_sizes(10, 4) == [3, 3, 2, 2]
    assert quantize.chunk_count(1, 1 << 30, 64) == 1
    x = np.random.default_rng(1).normal(size=(200, 8)) + 3
    base = points(spark, x)
    spread = np.mean(np.sum((x - x.mean(0)) ** 2, 1))
    errors = []
    for more in ({}, {"centre": False}, {"rotate": 8}):
        quantizer = quantize.train(base, 4, 16, **more)
        coded = {r.vec_id: (r.codes, r.error) for r in quantize.encode(base, quantizer).collect()}
        back = {r.vec_id: r.embedding for r in quantize.decode(quantize.encode(base, quantizer), quantizer).collect()}
        far = [np.sqrt(np.sum((np.array(back[i]) - x[i].astype(np.float32)) ** 2)) for i in range(200)]
        assert np.allclose([coded[i][1] for i in range(200)], far)
        errors.append(np.mean(np.square(far)))
        assert len(back) == 200 and errors[-1] < 0.6 * spread
        one = queries(spark, x[:3])
        by_table = {(r.qid, r.vec_id): r.distance for r in quantize.adc(one, quantize.encode(base, quantizer), quantizer).collect()}
        assert by_table == pytest.approx({(r.qid, r.vec_id): r.distance for r in quantize.by_code(one, quantize.encode(base, quantizer), quantizer).collect()})
        best = quantize.adc(one, quantize.encode(base, quantizer), quantizer, 4).collect()
        assert sorted(r.distance for r in best if r.qid == 1) == pytest.approx(sorted(d for (i, _), d in by_table.items() if i == 1)[:4])
        exact = sorted((r.qid, r["rank"], r.vec_id) for r in knn.nearest(base, one, 7).collect())
        assert exact == sorted((r.qid, r["rank"], r.vec_id) for r in quantize.search(base, quantize.encode(base, quantizer), one, quantizer, 7).collect())
    r = quantize.random_rotation(6)
    assert np.allclose(r @ r.T, np.eye(6))


def test_rotation_fits_turned_data(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 6)) * np.array([4, 4, 4, 0.1, 0.1, 0.1])  # all the variance in one chunk
    base = points(spark, x)
    plain, turned = quantize.train(base, 2, 8), quantize.train(base, 2, 8, rotate=20)
    error = lambda z: quantize.encode(base, z).agg(F.avg(F.col("error") * F.col("error"))).first()[0]
    assert error(turned) < 0.8 * error(plain)


def test_seeds_and_parts(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.05 + c for c in ((0, 0), (5, 5), (0, 9))])
    assert len({tuple(np.round(c / 3).astype(int)) for c in quantize.plus_plus(x, 3)}) == 3
    assert len(quantize.plus_plus(np.ones((4, 2)), 3)) == 3
    base = points(spark, x)
    homes = cluster.partition(base, 3, copies=1).toPandas()
    assert sorted(homes.groupby("center").size()) == [60, 60, 60]
    small = cluster.shards_within(base, cluster.ram_estimate(70, 2), 2, copies=1)
    assert small.groupBy("center").count().agg(F.max("count")).first()[0] <= 70
    few = cluster.some_ids(base, 10).collect()
    assert len({r.vec_id for r in few}) == 10 and [r.vec_id for r in few] == sorted(r.vec_id for r in few)
    assert 20 < cluster.drawn(base, 0.3).count() < 90


def test_files(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(25, 5)).astype("<f4")
    base, path = points(spark, x).repartition(3), str(tmp_path / "a.bin")
    assert files.write_bin(base, path) == 25
    got = sorted((r.vec_id, r.embedding) for r in files.read_bin(spark, path, rows=7).collect())
    assert np.array_equal(np.array([v for _, v in got], "<f4"), x)
    assert sorted(r.vec_id for r in files.read_bin(spark, path, start=3, count=4).collect()) == [3, 4, 5, 6]
    raw = (tmp_path / "a.bin").read_bytes()
    assert files.write_bin(base.limit(4), path, offset=len(raw)) == 4
    assert (tmp_path / "a.bin").read_bytes()[: len(raw)] == raw and (tmp_path / "a.bin").stat().st_size == len(raw) + 8 + 4 * 20
    with pytest.raises(ValueError):
        files.write_bin(base, path, offset=10**6)
    rowwise = str(tmp_path / "a.fvecs")
    files.write_rows(base, rowwise)
    assert (tmp_path / "a.fvecs").read_bytes() == b"".join(np.int32(5).tobytes() + r.tobytes() for r in x)
    assert files.read_rows(spark, rowwise, rows=10).count() == 25
    bytes_ = spark.createDataFrame([(0, [1, 255]), (1, [0, 7])], "vec_id bigint, embedding array<int>")
    files.write_rows(bytes_, str(tmp_path / "a.bvecs"), "uint8")
    assert sorted(r.embedding for r in files.read_rows(spark, str(tmp_path / "a.bvecs"), "uint8").collect()) == [[0.0, 7.0], [1.0, 255.0]]
    big = spark.createDataFrame([(0, [2**32 - 1, 16_777_217])], "vec_id bigint, embedding array<bigint>")
    files.write_rows(big, str(tmp_path / "a.ivecs"), "uint32")
    assert files.read_rows(spark, str(tmp_path / "a.ivecs"), "uint32").first().embedding == [2**32 - 1, 16_777_217]
    files.write_tsv(base, str(tmp_path / "tsv"))
    assert files.read_tsv(spark, str(tmp_path / "tsv")).count() == 25
    for bad in ([-1, 3], [3, 0], [3]):
        (tmp_path / "bad.bin").write_bytes(np.array(bad, "<i4").tobytes())
        with pytest.raises(ValueError):
            files.header(str(tmp_path / "bad.bin"))
    (tmp_path / "none.bin").write_bytes(np.array([0, 3], "<i4").tobytes())
    assert files.read_bin(spark, str(tmp_path / "none.bin")).count() == 0
    odd = spark.createDataFrame([(0, [float("nan"), float("inf"), float("-inf"), -0.0])], "vec_id bigint, embedding array<float>")
    files.write_bin(odd, str(tmp_path / "odd.bin"))
    assert np.array(files.read_bin(spark, str(tmp_path / "odd.bin")).first().embedding, "<f4").tobytes() == np.array([np.nan, np.inf, -np.inf, -0.0], "<f4").tobytes()


def test_truth_tag_and_graph_files(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(60, 4))
    base, q = points(spark, x), queries(spark, x[:7])
    truth = knn.nearest(base, q, 5).cache()
    rows = sorted((r.qid, r["rank"], r.vec_id, np.float32(r.distance)) for r in truth.collect())
    for far in (True, False):
        files.write_truth(truth, str(tmp_path / "t.bin"), 5, far)
        got = sorted((r.qid, r["rank"], r.vec_id, np.float32(r.distance) if far else None) for r in files.read_truth(spark, str(tmp_path / "t.bin")).collect())
        assert got == [r if far else (*r[:3], None) for r in rows]
    with pytest.raises(ValueError):
        files.write_truth(truth.where("rank < 5 OR qid > 2"), str(tmp_path / "u.bin"), 5)
    near = knn.nearest(base, q, 1, within=1.0)
    files.write_range_truth(near.where("qid <> 3"), str(tmp_path / "r.bin"), q)
    got = {r.qid: r.ids for r in files.read_range_truth(spark, str(tmp_path / "r.bin")).collect()}
    want = {i: [] for i in range(7)}
    for r in near.where("qid <> 3").orderBy("qid", "rank").collect():
        want[r.qid].append(r.vec_id)
    assert got == want
    tags = spark.createDataFrame([(i, [i + 1]) for i in range(9)], "vec_id bigint, embedding array<int>")
    files.write_bin(tags, str(tmp_path / "tags.bin"), "uint32")
    assert sorted(map(tuple, files.read_tags(spark, str(tmp_path / "tags.bin")).collect())) == [(i, i + 1) for i in range(9)]
    nodes = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "vec_id bigint, neighbours array<bigint>")
    assert files.write_graph(nodes, str(tmp_path / "g"), start=2, frozen=1) == 3
    assert files.graph_header(str(tmp_path / "g")) == {"bytes": 24 + 4 * 6, "degree": 2, "start": 2, "frozen": 1}
    assert sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g")).collect())) == [(0, [1, 2]), (1, []), (2, [0])]
    (tmp_path / "g").write_bytes((tmp_path / "g").read_bytes() + b"1234")
    with pytest.raises(ValueError):
        files.read_graph(spark, str(tmp_path / "g"))
    (tmp_path / "f.txt").write_text("a\r\nb\nc")
    assert sorted(map(tuple, files.read_filters(spark, str(tmp_path / "f.txt"), unique=True, queries=3).collect())) == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "one.txt").write_text("a\n")
    assert files.read_filters(spark, str(tmp_path / "one.txt"), queries=4).count() == 4
    with pytest.raises(ValueError):
        files.read_filters(spark, str(tmp_path / "f.txt"), queries=2)
    (tmp_path / "p.tsv").write_text("p0\tfirst\tone\np1\tsecond\n")
    files.write_bin(base.where("vec_id < 2"), str(tmp_path / "p.bin"))
    assert [(r.passage_id, r.text) for r in files.read_passages(spark, str(tmp_path / "p.tsv"), str(tmp_path / "p.bin")).orderBy("vec_id").collect()] == [("p0", "first\tone"), ("p1", "second")]
    found = truth.withColumn("width", F.lit(20))
    names = files.write_result_matrices(found, str(tmp_path / "res"), 5)
    assert len(names) == 2 and files.header(names[0]) == (7, 5)
    files.write_results(truth, str(tmp_path / "csv"))
    nodes.withColumn("embedding", F.array(F.lit(0.5), F.lit(2.0))).write.parquet(str(tmp_path / "n"))
    files.write_index_tsv(spark.read.parquet(str(tmp_path / "n")), str(tmp_path / "index.tsv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "index.tsv")).collect()) == ["0\t0.5,2.0\t1,2", "1\t0.5,2.0\t", "2\t0.5,2.0\t0"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["qid", "rank", "id", "distance"]


def test_index_and_requests(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(80, 4))
    base = points(spark, x)
    for bad in (base.where("false"), base.unionByName(base.limit(1)), points(spark, x[:, :3])):
        with pytest.raises(BuildError) as caught:
            VectorIndex.build(bad, IndexSpec(dim=4))
        assert error_code(caught.value) == 4
    with pytest.raises(SearchError) as caught:
        VectorIndex.build(base, IndexSpec(dim=4)).search(queries(spark, x[:1]), 5, 3)
    assert [error_code(e) for e in (None, ValueError(), MemoryError(), FileNotFoundError(), caught.value)] == [0, 1, 2, 3, 5]
    for bad in ({"dim": 5, "metric": "none"}, {"dim": 0}, {"dim": 2, "frozen": -1}, {"dim": 2, "universal": "U"}, {"dim": 2, "alphas": (0.5,)}):
        with pytest.raises(ValueError):
            IndexSpec(**bad)
    asked = spark.createDataFrame([('{"query_id": 1, "query": [0, 0, 0, 0], "k": 2, "Ls": 5}',), ('{"query_id": 2, "query": [], "k": 2, "Ls": 5}',), ('{"query_id": 3, "query": [0, 0, 0, 0], "k": 9, "Ls": 5}',)], "value string")
    tags = base.select("vec_id", F.concat(F.lit("t"), "vec_id").alias("tag"))
    got = [json.loads(r.value) for r in answer(base, asked, tags=tags, partition=3, timed=True).collect()]
    assert len(got) == 3 and sum("error" in r for r in got) == 2
    (good,) = [r for r in got if "error" not in r]
    assert good["tags"] == [f"t{i}" for i in good["indices"]] and good["partition"] == 3 and good["time_taken_in_us"] >= 0


def test_sql_functions(spark):
    x = np.random.default_rng(6).normal(size=(200, 4))
    index = VectorIndex.build(points(spark, x), IndexSpec(dim=4, degree=12, build_width=24, shard_rows=120))
    register(spark)
    index.nodes.createOrReplaceTempView("nodes_for_test")
    q = ", ".join(f"{v}f" for v in x[3].astype(np.float32))
    rows = spark.sql(f"SELECT DISTINCT * FROM ann_search(TABLE(nodes_for_test) PARTITION BY (shard), array({q}), 5, 40, 'l2') ORDER BY distance, vec_id LIMIT 5").collect()
    assert [r.vec_id for r in rows] == [r.vec_id for r in index.exact(queries(spark, x[3:4]), 5).orderBy("rank").collect()]
    assert spark.sql("SELECT vec_dot(array(1f, 2f, 9f), array(3f, 4f)) a, vec_l2sq(array(1f), array(3f)) b, vec_l1(array(1f), array(3f, 4f)) c").first() == (11.0, 4.0, float("inf"))


def test_stream(spark, tmp_path):
    schema = "op string, vec_id bigint, embedding array<float>, seq bigint"
    for i, part in enumerate([[("insert", 1, [1.0], 0), ("insert", 2, [2.0], 1)], [("delete", 1, None, 2), ("insert", 3, [3.0], 3)]]):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        window.apply_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.vec_id for r in window.current(spark, f"{tmp_path}/out").collect()) == [2, 3]
    with pytest.raises(ValueError):
        window.check(10, 8, 5)


def test_stream_changes_a_live_index(spark, tmp_path):
    rng = np.random.default_rng(31)
    x = {i: [float(np.float32(v)) for v in rng.normal(size=4)] for i in range(120)}
    new5 = [9.0, 9.0, 9.0, 9.0]
    batches = [
        [("insert", i, x[i], i) for i in range(80)],
        [("delete", i, None, 100 + i) for i in range(0, 80, 4)] + [("insert", i, x[i], 300 + i) for i in range(80, 120)] + [("delete", 81, None, 900), ("delete", 5000, None, 901)],
        [("insert", 5, new5, 1000), ("insert", 4, x[4], 1001), (None, None, None, 1002)],
    ]
    spec, schema = IndexSpec(dim=4, degree=12, build_width=24, shard_rows=60), "op string, vec_id bigint, embedding array<float>, seq bigint"
    want: dict = {}
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        live_index.apply_stream(stream, f"{tmp_path}/index", f"{tmp_path}/ck", spec, consolidate_every=2).awaitTermination()
        for op, i, v, _ in part:
            want.pop(i, None)
            if op == "insert":
                want[i] = v
        index = live_index.newest(spark, f"{tmp_path}/index")
        assert {r.vec_id: r.embedding for r in index.points.collect()} == want
        asked = queries(spark, [x[i] for i in range(0, 60, 3)])
        assert share(index.search(asked, 5, 50), index.exact(asked, 5)) >= 0.9
    assert live_index.versions(spark, f"{tmp_path}/index") == [0, 1, 2]
    assert index.search(queries(spark, [new5]), 1, 20).first().vec_id == 5


def test_metric_flags():
    assert {name: flags[1:] for name, flags in V.METRICS.items()} == {"l2": (True, True), "l1": (True, True), "cosine": (True, False), "ip": (False, False)}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_best_scores_few_pairs_with_the_same_bits(metric, monkeypatch):
    """Ties, zero vectors, large and small numbers: the rows of a plain ranking, and no full matrix of exact scores."""
    rng = np.random.default_rng(3)
    for scale, shift in ((1.0, 0.0), (1e-25, 0.0), (1.0, 1e4), (1e120, 0.0)):
        x = rng.normal(size=(1500, 12)) * scale + shift
        x[700:720], x[30] = x[3], 0.0
        ids = rng.permutation(1500).astype(np.int64)
        plain = np.zeros((1500, 1500))
        for d in range(12):
            plain += np.abs(x[:, d, None] - x[:, d]) if metric == "l1" else (x[:, d, None] - x[:, d]) ** 2 if metric == "l2" else x[:, d, None] * x[:, d]
        if metric == "cosine":
            norm = sum(x[:, d] * x[:, d] for d in range(12))
            with np.errstate(divide="ignore", invalid="ignore"):
                plain = np.where((norm[:, None] == 0) | (norm == 0), 1.0, 1 - np.clip(plain / (np.sqrt(norm)[:, None] * np.sqrt(norm)), -1, 1))
        plain = -plain if metric == "ip" else plain
        assert np.array_equal(knn.scores(metric, x, x), plain)
        np.fill_diagonal(plain, np.inf)
        order = np.lexsort((np.broadcast_to(ids, plain.shape), plain), axis=1)[:, :5]
        with monkeypatch.context() as m:
            if metric != "l1" and scale < 1e100:
                m.setattr(knn, "scores", None)
            best = knn.Best(ids, x, 5, metric, True)
            for i in range(0, 1500, 400):
                best.offer(ids[i : i + 400], x[i : i + 400])
        assert np.array_equal(best.names, ids[order]) and np.array_equal(best.scores, np.take_along_axis(plain, order, 1))


def test_blocks_are_partitions_of_their_own(spark):
    rng = np.random.default_rng(4)
    base = points(spark, rng.normal(size=(300, 4)))
    q = base.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = knn.nearest(base, q, 3, skip_self=True, most=250)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    assert sorted(found.collect()) == sorted(knn.nearest(base, q, 3, skip_self=True).collect())


def test_exact_edges_are_worked_out_once(spark):
    """A plan that reads the edges several times reads a table."""
    from conftest import DATA

    from nearfield.plans import core

    assert "MapInArrow" not in core._edges(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()


def test_levels_of_a_long_chain(spark, oracle, tmp_path):
    """A chain of 38 nodes, none of which is left out and which is beyond any plan's tables; and the query with its SQL, on
    points along a curve, most of them more than twelve steps from the first."""
    from nearfield.operators import graph
    from nearfield.plans import core

    edges = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(i, i - 1) for i in range(1, 38)], "src bigint, dst bigint")
    found = graph.levels(edges, spark.createDataFrame([(0,)], "vec_id bigint"))
    assert sorted((r.vec_id, r.level) for r in found.collect()) == [(i, i) for i in range(38)]
    rows = [(i, [float(i), float(i * i) / 400] + [0.0] * 62, i % 10) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.level, r.n) for r in core.QUERIES["bfs_levels"](spark, str(tmp_path)).collect())
    assert got == sorted((int(r.level), int(r.n)) for r in oracle(core.SQL["bfs_levels"], str(tmp_path)).itertuples())
    assert got[-1][0] > 12 and sum(n for _, n in got) == 120



def test_sums_of_distances_without_a_matrix_of_scores(spark, monkeypatch):
    """Equal and near points, points far from the origin, points of two lengths in several blocks."""
    rng = np.random.default_rng(6)
    for scale, shift in ((1.0, 0.0), (1.0, 1e4), (1e-5, 3.0)):
        x = rng.normal(size=(300, 6)) * scale + shift
        x[7] = x[8]
        plain = np.sqrt(((x[:, None] - x) ** 2).sum(-1)).sum(1)
        with monkeypatch.context() as m:
            m.setattr(cluster, "scores", None)
            assert np.allclose(cluster._summed(x, x), plain, rtol=1e-12)
    x = [r.tolist() for r in rng.normal(size=(60, 6))] + [r.tolist() for r in rng.normal(size=(20, 4))]
    far = lambda a, b: float(np.sqrt(((np.array(a, np.float32).astype(float) - np.array(b, np.float32).astype(float)) ** 2).sum()))
    got = {r.vec_id: r.total for r in cluster.distance_sums(points(spark, x), 100).collect()}
    assert got == pytest.approx({i: sum(far(a, b) for b in x if len(a) == len(b)) for i, a in enumerate(x)})


def test_distances_of_odd_vectors_and_without_columns(spark):
    """Every kind of value is that of its column, also for vectors that are null, of other lengths, with nulls, or not
    finite; sound vectors need no join."""
    from nearfield.plans import core

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(40, None), (41, [1.0, 2.0]), (42, [1.0, None, 2.0, 1.0, 0.5, 3.0]), (43, [0.0] * 6), (44, [float("inf"), float("nan"), 0.0, 1.0, 1.0, 1.0]), (45, [])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = base.where("vec_id % 4 = 0 OR vec_id > 39").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    for values, value, _ in core._PAIRS.values():
        want = {(r.qid, r.vec_id): r.distance for r in knn.against(base, asked).select("qid", "vec_id", value(F.col("q"), F.col("embedding")).alias("distance")).collect()}
        got = {(r.qid, r.vec_id): r.distance for r in knn.distances(base, asked, values, value).collect()}
        assert got.keys() == want.keys() and len(got) == 46 * 16
        for at, x in want.items():
            assert got[at] == x or x != x and got[at] != got[at] or values == "minkowski3" and got[at] == pytest.approx(x, rel=1e-14), (values, at)
    sound = base.where("vec_id < 40")
    plan = knn.distances(sound, sound.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "l2sq", V.l2sq)._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_nearest_of_labels(spark):
    """Labels that come twice, several lengths, and more labels than a task keeps; no pair of all is shuffled."""
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=3 + (i % 9 == 0)).round(1).tolist(), [str(i % 7), str(i % 5), "x"]) for i in range(400)] + [(400, None, ["x"])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, labels array<string>")
    asked = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    value = knn.against(base.select("vec_id", "embedding", F.explode(F.array_distinct("labels")).alias("label")), asked).select("qid", "vec_id", "label", V.l2sq(F.col("q"), F.col("embedding")).alias("distance"))
    from pyspark.sql import Window

    want = value.where("distance < double('infinity')").withColumn("rank", F.row_number().over(Window.partitionBy("qid", "label").orderBy("distance", "vec_id"))).where("rank <= 5")
    found = knn.nearest_of_labels(base, asked, 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    plain = lambda df: sorted((r.qid, r.label, r["rank"], r.vec_id, r.distance) for r in df.collect())
    assert plain(found) == plain(want)


def test_both_distances_by_code_in_one_pass(spark):
    from conftest import DATA

    from nearfield.plans import core, more  # noqa: F401  more adds to core's tables

    plan = core.QUERIES["pq_distance_by_code"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_code_search_works_in_blocks(spark, monkeypatch):
    """No task looks up all queries and a whole batch at once; the rows are those of the exact search."""
    from conftest import DATA

    from nearfield.plans import core

    folder, plain = f"{DATA}/sf0.001", quantize._looked_up
    e, q = core._e(spark, folder), core._q(spark, folder)
    quantizer = quantize.train(e, 16, 64)

    monkeypatch.setattr(quantize, "AT_ONCE", 1000, raising=False)
    found, want = quantize.search(e, quantize.encode(e, quantizer), q, quantizer, 10), knn.nearest(e, q, 10)
    key = lambda r: (r.qid, r["rank"], r.vec_id, r.distance)
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    x = np.random.default_rng(2).normal(size=(500, 4))
    monkeypatch.setattr(quantize, "ROWS", 64)
    blocks = quantize.lloyd(x, x[:8], 6)
    monkeypatch.setattr(quantize, "ROWS", 10_000)
    assert np.allclose(blocks, quantize.lloyd(x, x[:8], 6))
    sizes = []
    monkeypatch.setattr(quantize, "_looked_up", lambda table, codes: sizes.append(table.shape[0] * len(codes)) or plain(table, codes))
    monkeypatch.setattr(quantize, "map_arrow", lambda df, function, schema: spark.createDataFrame([b for x in function(iter(df.toArrow().to_batches())) for b in x.to_pylist()], schema))
    assert quantize.search(e, quantize.encode(e, quantizer), q, quantizer, 10).count() == want.count() and max(sizes) <= 1000


def test_one_index_of_several_shards(spark):
    """Its status has one shard and one start; it knows each point once, and searches of it are as good."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 8))
    p = points(spark, x).withColumn("labels", F.array((F.col("vec_id") % 3).cast("string")))
    nodes = vamana.build(p, 12, 24, shard_rows=150, labelled=True).cache()
    one = vamana.joined(nodes, 12).cache()
    assert nodes.select("shard").distinct().count() > 1 and one.columns == nodes.columns and one.dtypes == nodes.dtypes
    said = vamana.status(one, spark.createDataFrame([(3,), (999,)], "vec_id bigint")).first()
    assert (said.points, said.deleted, said.live, said.shards, said.starts, said.frozen) == (500, 1, 499, 1, 1, 0)
    assert sorted(sum((r.start_of for r in one.collect()), [])) == ["0", "1", "2"] and one.agg(F.max(F.size("neighbours"))).first()[0] <= 12
    q = queries(spark, x[::25])
    truth = {(r.qid, r.vec_id) for r in knn.nearest(p, q, 5).collect()}
    assert len({(r.qid, r.vec_id) for r in vamana.search(one, q, 5, 60).collect()} & truth) >= 0.9 * len(truth)


def test_shards_are_tasks_of_their_own(spark):
    """However their numbers hash."""
    from pyspark import TaskContext
    from pyspark.sql.types import LongType

    task = F.udf(lambda: TaskContext.get().partitionId(), LongType()).asNondeterministic()
    nodes = vamana.build(points(spark, np.random.default_rng(1).normal(size=(200, 4))), 4, 8, shard_rows=20)
    found = nodes.select("shard", task().alias("task")).distinct().collect()
    assert len(found) == len({r.task for r in found}) > 10


def test_indexes_are_built_once(spark):
    """Queries that read an index several times read a table."""
    from conftest import DATA

    from nearfield.plans import core, more  # noqa: F401  more adds to core's tables

    for name in ("vamana_build", "index_status", "vamana_width_sweep"):
        assert core.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString().count("FlatMapGroupsInPandas") == 0, name


def test_few_numbers_are_pruned_together(monkeypatch):
    """Pools' distances stay within their bound, and a walk's order is that of both keys."""
    rng = np.random.default_rng(5)
    x, seen = rng.normal(size=(400, 4)), []
    among = proximity._among
    monkeypatch.setattr(proximity, "_among", lambda metric, v: seen.append(v.shape[0] * v.shape[1] ** 2) or among(metric, v))
    monkeypatch.setattr(proximity, "MOST_BETWEEN", 5000, raising=False)
    proximity.Graph(x, degree=6, width=12).build()
    assert max(seen) <= max(5000, 400 * 4)
    d = np.where(rng.random((50, 30)) < 0.2, np.inf, rng.integers(0, 20, (50, 30)) / 4.0)
    p = np.where(np.isinf(d), -1, rng.permuted(np.tile(np.arange(30), (50, 1)), axis=1))
    order, want = proximity._ordered(d, p), np.lexsort((p, d), axis=1)
    assert np.array_equal(np.take_along_axis(d, order, 1), np.take_along_axis(d, want, 1)) and np.array_equal(np.take_along_axis(p, order, 1), np.take_along_axis(p, want, 1))


def test_recall_gates_work_out_each_truth_once(spark, monkeypatch):
    """Of all points, the live ones, those in range and those with a label; and the index that grows is built before."""
    from conftest import DATA

    from nearfield.plans import core, more

    asked, grown = [], []
    nearest, insert = knn.nearest, vamana.insert
    monkeypatch.setattr(more.knn, "nearest", lambda *a, **b: asked.append(a) or nearest(*a, **b))
    monkeypatch.setattr(more.vamana, "insert", lambda nodes, new: grown.append(nodes._jdf.queryExecution().toString()) or insert(nodes, new))
    core.QUERIES["search_recall_gates"](spark, f"{DATA}/sf0.001")
    assert len(asked) == 4 and "FlatMapGroups" not in grown[0]


def test_filtered_search_of_a_sparse_label(spark):
    """A tenth of the points match, and a node has few neighbours among them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24))
    p = points(spark, x).withColumn("labels", F.array((F.col("vec_id") * 7 % 10).cast("string")))
    q = queries(spark, rng.normal(size=(60, 24))).withColumn("wanted", F.lit("3"))
    found = vamana.search(vamana.build(p, 12, 24, labelled=True), q, 10, 20)
    truth = {(r.qid, r.vec_id) for r in knn.nearest(p.where(F.array_contains("labels", "3")), q, 10).collect()}
    assert {(r.qid, r.vec_id) for r in found.collect()} == truth
