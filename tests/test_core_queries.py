"""Every query of the vector-search operators against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA, rows

from nearfield.operators import evaluate, knn
from nearfield.plans import core, more  # noqa: F401


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, oracle, name):
    folder = f"{DATA}/sf0.001"
    assert rows(core.QUERIES[name](spark, folder).toPandas()) == rows(oracle(core.SQL[name], folder))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_pq_search_recall(spark, size):
    folder = f"{DATA}/{size}"
    truth = {(r.qid, r.vec_id) for r in core.QUERIES["knn_exact_l2"](spark, folder).collect()}
    found = {(r.qid, r.vec_id) for r in core.QUERIES["pq_search"](spark, folder).collect()}
    assert len(found & truth) >= 0.9 * len(truth)


#: Approximate searches and the exact ones that they are held against.
EXACT = {
    "vamana_search": "knn_exact_l2",
    "vamana_beam_search": "knn_exact_l2",
    "vamana_fast_search": "knn_exact_l2",
    "vamana_nearest_start": "knn_exact_l2",
    "vamana_code_search": "knn_exact_l2",
    "vamana_code_rerank": "knn_exact_l2",
    "vamana_insert": "knn_exact_l2",
    "vamana_search_points": "knn_exact_l2",
    "index_save_load": "knn_exact_l2",
    "vamana_live_search": "knn_live",
    "vamana_remove": "knn_live",
    "vamana_filtered_search": "knn_filtered_universal",
}


def test_recall_of_searches(spark):
    folder, truth = f"{DATA}/sf0.001", {}
    for name, exact in EXACT.items():
        if exact not in truth:
            truth[exact] = {(r.qid, r.vec_id) for r in core.QUERIES[exact](spark, folder).collect()}
        found = {(r.qid, r.vec_id) for r in core.QUERIES[name](spark, folder).collect()}
        assert len(found & truth[exact]) >= 0.9 * len(truth[exact]), name


def test_recall_gates_of_the_larger_table(spark, oracle):
    folder, name = f"{DATA}/sf0.1", "search_recall_gates"
    assert rows(core.QUERIES[name](spark, folder).toPandas()) == rows(oracle(core.SQL[name], folder))


def test_other_queries_without_sql(spark):
    folder, run = f"{DATA}/sf0.001", lambda name: core.QUERIES[name](spark, f"{DATA}/sf0.001")
    near = {(r.qid, r.vec_id) for r in knn.nearest(core._e(spark, folder), core._q(spark, folder), 1, within=1.3).collect()}
    found = {(r.qid, r.vec_id) for r in run("vamana_range_search").collect()}
    assert found <= near and len(found) >= 0.9 * len(near)
    assert {r.norm2 for r in run("synthetic_vectors").collect()} == {1.0}
    assert all(abs(r.norm2 - 1) < 1e-5 for r in run("random_rotation").collect())
    curve = {r.width: r for r in run("vamana_width_sweep").collect()}
    assert sorted(curve) == [10, 50, 100] and curve[100].recall >= 95 and curve[10].mean_compared < curve[100].mean_compared
    rows = run("recall_simulation").toPandas()
    assert len(rows) == 200 and 90 < rows.recall.mean() <= 100
    errors = {r.rounds: r.error for r in run("pq_rotated").collect()}
    assert errors[10] <= 1.05 * errors[0]
    assert run("ann_table_function").count() == 10 and run("kmeans_seeds").count() == 8
    for name in ("graph_prune_all", "graph_delete_prune", "vamana_stitched"):
        most = {"graph_prune_all": 5, "graph_delete_prune": 8, "vamana_stitched": 32}[name]
        assert run(name).groupBy("src").count().agg({"count": "max"}).first()[0] <= most
    assert run("latency_report").first().n > 0 and run("vamana_visit_cache").count() == 40
    parts = run("partition_ram_budget").groupBy("center").count().toPandas()
    assert parts["count"].sum() == 500 and parts["count"].max() <= 250
    with pytest.raises(ValueError, match="below"):
        evaluate.gate(spark.createDataFrame([(50.0,)], "recall double"), 90.0)


def test_commands(spark, tmp_path, capsys):
    from nearfield.__main__ import main

    run = lambda *a: main([str(x) for x in a], spark)
    assert run("generate", "--out", tmp_path / "v.bin", "--n", 300, "--dim", 8) == 0
    assert run("generate", "--out", tmp_path / "q.bin", "--n", 10, "--dim", 8, "--seed", 5) == 0
    assert run("convert", "--data", tmp_path / "v.bin", "--out", tmp_path / "v.fvecs") == 0
    assert run("build", "--data", tmp_path / "v.fvecs", "--index", tmp_path / "index", "--degree", 16, "--width", 32, "--shard-rows", 200) == 0
    assert run("truth", "--data", tmp_path / "v.bin", "--queries", tmp_path / "q.bin", "--out", tmp_path / "t.bin", "--k", 20) == 0
    assert run("search", "--index", tmp_path / "index", "--queries", tmp_path / "q.bin", "--truth", tmp_path / "t.bin", "--widths", 10, 60, "--out", tmp_path / "found", "--matrices", tmp_path / "m", "--least-recall", 90) == 0
    assert run("search", "--index", tmp_path / "index", "--queries", tmp_path / "q.bin", "--truth", tmp_path / "t.bin", "--least-recall", 100.5) == 2
    assert run("within", "--index", tmp_path / "index", "--queries", tmp_path / "q.bin", "--radius", 9, "--out", tmp_path / "near") == 0
    (tmp_path / "ids").write_text("3\n4\n999\n")
    assert run("delete", "--index", tmp_path / "index", "--ids", tmp_path / "ids", "--out", tmp_path / "index2", "--consolidate") == 0
    assert run("insert", "--index", tmp_path / "index2", "--data", tmp_path / "q.bin", "--out", tmp_path / "index3") == 0
    assert run("stats", "--index", tmp_path / "index2") == 0
    assert run("sample", "--data", tmp_path / "v.bin", "--out", tmp_path / "s", "--share", 0.5) == 0
    assert run("partition", "--data", tmp_path / "v.bin", "--out", tmp_path / "p", "--parts", 4) == 0
    assert run("codes", "--data", tmp_path / "v.bin", "--out", tmp_path / "c", "--chunks", 4, "--codes", 16) == 0
    assert run("generate", "--out", tmp_path / "l", "--n", 100, "--dim", 4, "--label-count", 5) == 0
    assert run("stitch", "--data", tmp_path / "l", "--out", tmp_path / "st", "--degree", 8, "--width", 16) == 0
    said = [__import__("json").loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {"failed": 1, "points": 300, "deleted": 2, "live": 298} .items() <= next(x for x in said if "failed" in x).items()
    assert next(x for x in said if "rejected" in x)["rejected"] == 8  # ids 3 and 4 are free again


def test_core_without_the_text_operators(tmp_path):
    """A copy without the two folders, and one in which their import fails."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    for name in ("gone", "broken"):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
        if name == "gone":
            shutil.rmtree(copy / "nearfield/llm", ignore_errors=True)
            (copy / "nearfield/llm/__pycache__").mkdir(parents=True)
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        elif (copy / "nearfield/llm").exists():
            (copy / "nearfield/llm/queries.py").write_text("import a_library_that_is_not_there")
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n[:2] == 'op' for n in e.queries()))"], cwd=copy, capture_output=True, text=True)
        n, with_sql, text = said.stdout.split()
        assert int(n) == len(core.QUERIES) + (name == "broken" and (copy / "corpus_pipeline.py").exists()) and int(with_sql) == len(core.SQL) and text == "False", said.stderr
