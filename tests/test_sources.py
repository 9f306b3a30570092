"""LIBSVM files, vectors, run logs and sweeps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from slopeworks import SgdConfig, dense_set, fit, sweep, sweep_configs, vector_set
from slopeworks.operators import history
from slopeworks.__main__ import main
from slopeworks.plans.experiment import named_experiment
from slopeworks.sources.libsvm import dataset_pair, read_libsvm, to_libsvm_lines
from slopeworks.sources.run_log import log_tables, parse_run_log, read_run_log, run_log_lines

from helpers import random_rows

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")


def test_libsvm_with_carriage_returns_and_blanks(spark, tmp_path):
    path = tmp_path / "rows"
    path.write_bytes(b"1 1:0.5 4:2 \r\n0 2:1e1\r\n1 3:-1")
    got = read_libsvm(spark, str(path), 6).orderBy("idx").collect()
    assert sorted((r["label"], r["idx"], r["val"]) for r in got) == [
        (0.0, [1], [10.0]), (1.0, [0, 3], [0.5, 2.0]), (1.0, [2], [-1.0]),
    ]
    dense = read_libsvm(spark, str(path), 4, dense=True).filter("label = 0").first()
    assert dense["features"] == [0.0, 10.0, 0.0, 0.0]


def test_dataset_pairs(spark, tmp_path):
    (tmp_path / "svmguide1").write_text("1 1:1 2:2 3:3 4:4\n0 1:1\n")
    (tmp_path / "svmguide1.t").write_text("1 1:1\n")
    train, test, width = dataset_pair(spark, "svmguide", str(tmp_path))
    assert width == 4 and train.count() == 2 and len(test.first()["features"]) == 4
    (tmp_path / "a9a").write_text("1 3:1 11:1\n0 5:1\n")
    (tmp_path / "a9at").write_text("1 3:1\n")
    train, test, width = dataset_pair(spark, "adult", str(tmp_path))
    assert width == 123 and train.columns == ["label", "idx", "val"]
    found = named_experiment(spark, str(tmp_path), "adult", 3, 1.0, 1.0, 2, "lr")
    assert found.runs.first()["test_acc"] == 1.0
    with pytest.raises(ValueError, match="unknown dataset"):
        dataset_pair(spark, "none", str(tmp_path))


def test_command_line_prints_a_log_that_can_be_read(spark, tmp_path, capsys):
    (tmp_path / "svmguide1").write_text("1 1:1 2:2\n0 1:-1\n1 1:2\n")
    (tmp_path / "svmguide1.t").write_text("1 1:1\n0 1:3\n")
    main(["svmguide", "6", "0.2", "1", "3", "svm", "--data", str(tmp_path)])
    text = capsys.readouterr().out
    table, runs = log_tables(parse_run_log(lines_of(spark, tmp_path, text)))
    row = runs.first()
    assert (row["updater"], row["alg"], row["rate"]) == (6, "svm", 0.2)
    assert row["train_acc"] == 1.0 and row["test_acc"] == 0.5
    assert [r["iteration"] for r in table.orderBy("iteration").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="algorithm"):
        named_experiment(spark, str(tmp_path), "svmguide", 0, 0.1, 1.0, 1, "none")


def test_sweep_tables_are_saved(spark, tmp_path):
    rows = random_rows(spark, 100, 3)
    base = SgdConfig(num_iterations=2, convergence_tol=0.0)
    for _ in range(2):
        sweep(rows, rows, sweep_configs(base, ("adam",), (0.0,))).save(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    assert spark.read.parquet(str(tmp_path / "history")).count() == 4


def test_libsvm_lines_round_trip(spark, tmp_path):
    rows = random_rows(spark, 50, 4)
    to_libsvm_lines(rows).write.text(str(tmp_path / "text"))
    back = read_libsvm(spark, str(tmp_path / "text"), 4, dense=True)
    key = lambda r: (r["label"], r["features"])
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))


def test_vector_columns(spark):
    rows = spark.createDataFrame(
        [(1.0, Vectors.dense([1.0, 0.0, 2.0])), (0.0, Vectors.sparse(3, [1], [5.0]))], ["label", "features"]
    )
    got = [(r["idx"], r["val"]) for r in vector_set(rows).orderBy("label").collect()]
    assert got == [([1], [5.0]), ([0, 1, 2], [1.0, 0.0, 2.0])]


def test_only_named_columns_are_read(spark):
    rows = dense_set(
        spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_discount > 0.05", ["l_quantity"]
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "l_quantity" in schema and "l_discount" in schema and "l_tax" not in schema


# Published losses at iteration 20, three rates per updater, and the rate each updater is to get.
RATES = {
    0: (10, 1, 0.1), 1: (10, 1, 0.1), 2: (10, 1, 0.1), 3: (10, 1, 0.1), 4: (10, 1, 0.1),
    5: (10, 1, 0.1), 6: (2, 0.2, 0.02), 7: (20, 2, 0.2), 8: (2, 0.2, 0.02), 9: (2, 0.2, 0.02),
}
LOSSES = {
    0: (0.357807, 0.460300, 0.648663), 1: (0.368594, 0.381580, 0.500482), 2: (0.325081, 0.373447, 0.495009),
    3: (0.160334, 0.185322, 0.379197), 4: (0.686886, 0.686886, 0.686886), 5: (0.596248, 0.159503, 0.249969),
    6: (0.157724, 0.201945, 0.394133), 7: (float("nan"),) * 3, 8: (0.122545, 0.188118, 0.380219),
    9: (0.441052, 0.145357, 0.251386),
}
BEST = {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 1, 6: 2, 7: 20, 8: 2, 9: 0.2}


def published_log() -> str:
    lines = ["session started", "", "INFO something"]
    for updater, rates in RATES.items():
        for rate, loss in zip(rates, LOSSES[updater]):
            lines += [f"Loss in iteration {i} : {0.7}" for i in range(1, 20)]
            lines.append(f"Loss in iteration 20 : {'NaN' if loss != loss else loss}")
            lines.append(
                f"Testing accuracy  of updater {updater} on alg 0 with rate {float(rate)} = 0.9, "
                f"training accuracy 0.8, time elapsed: 9769 millisecond."
            )
    return "\n".join(lines + ["Loss in iteration 1 : 0.5"])


@pytest.mark.parametrize("split", [None, 700])
def test_published_log(spark, tmp_path, split):
    """The same tables whether the file is one block or many."""
    path = tmp_path / "log.txt"
    path.write_text(published_log())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        lines = read_run_log(spark, str(path))
        if split:
            assert lines.select("block").distinct().count() > 10
        table, runs = log_tables(parse_run_log(lines))
        assert table.count() == 600 and runs.count() == 30
        assert [r["run_id"] for r in runs.orderBy("run_id").collect()] == list(range(30))
        third = table.filter("run_id = 16 AND iteration = 20").first()
        assert (third["updater"], third["rate"], third["loss"]) == (5, 1.0, 0.159503)
        best = {r["updater"]: r["rate"] for r in history.best_rates(table, runs).collect()}
        assert best == {u: float(r) for u, r in BEST.items()}
        curves = history.best_curves(table, runs)
        assert curves.filter("panel = 1").count() == 6 * 20 and curves.filter("panel = 2").count() == 5 * 20
        assert curves.filter("updater = 0").count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_short_runs(spark):
    runs = spark.createDataFrame(
        [(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0), (3, 1, 1.0), (4, 1, 2.0), (5, 2, 1.0)],
        "run_id int, updater int, rate double",
    )
    table = spark.createDataFrame(
        [(1, 5, 1.5), (2, 5, 0.9), (3, 5, 0.4), (4, 4, 0.1)], "run_id int, iteration int, loss double"
    )
    best = {r["updater"]: r["rate"] for r in history.best_rates(table, runs, 5).collect()}
    # a short first run is held to 1, a later short run is passed over, a lone short run stays
    assert best == {0: 3.0, 1: 1.0, 2: 1.0}


def test_log_round_trip(spark, tmp_path):
    table, runs = log_tables(parse_run_log(lines_of(spark, tmp_path, published_log())))
    text = run_log_lines(table, runs).orderBy("run_id", "position").select("value")
    again = "\n".join(r["value"] for r in text.collect())
    table2, runs2 = log_tables(parse_run_log(lines_of(spark, tmp_path, again, "again.txt")))
    assert runs2.drop("source").exceptAll(runs.drop("source")).count() == 0
    assert table2.drop("source").exceptAll(table.drop("source")).count() == 0


def lines_of(spark, folder, text, name="log.txt"):
    (folder / name).write_text(text)
    return read_run_log(spark, str(folder / name))


def test_sweep_grid():
    configs = sweep_configs()
    assert len(configs) == 70
    assert [c.step_size for c in configs[:3]] == pytest.approx([1.0, 0.7, 0.4])
    assert configs[4 * 7].step_size == pytest.approx(1000.0) and configs[4 * 7].updater == "adadelta"
    assert configs[0].num_iterations == 200 and configs[0].mini_batch_fraction == 0.25


def test_sweep(spark):
    rows = random_rows(spark, 400, 3)
    base = SgdConfig(num_iterations=6, convergence_tol=0.0)
    found = sweep(rows, rows, sweep_configs(base, updaters=("simple", "adam"), variations=(9.0, 0.0)))
    runs = found.runs.orderBy("run_id").collect()
    assert len(runs) == 4 and all(r["train_acc"] == r["test_acc"] for r in runs)
    assert found.history.count() == 24
    best = history.best_rates(found.history, found.runs, 6)
    want = {}
    for r, result in zip(runs, found.results):
        want.setdefault(r["updater"], []).append((result.losses[-1], r["rate"]))
    assert {r["updater"]: r["rate"] for r in best.collect()} == {u: min(v)[1] for u, v in want.items()}
    last = history.last_losses(found.history.filter("run_id = 0"), 3)
    assert [r["iteration"] for r in last.collect()] == [6, 5, 4]


def test_libsvm_training(spark, tmp_path):
    rows = random_rows(spark, 200, 5)
    to_libsvm_lines(rows).write.text(str(tmp_path / "t"))
    config = SgdConfig(updater="adam", num_iterations=3, step_size=0.1)
    a = fit(rows, config)[0]
    b = fit(read_libsvm(spark, str(tmp_path / "t"), 5), config, num_features=5)[0]
    np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-10)


def test_curves_keep_every_row(spark):
    table = spark.range(1000).select(
        (F.col("id") % 2).cast("int").alias("run_id"), F.col("id").cast("int").alias("iteration"),
        F.lit(0.5).alias("loss"),
    )
    runs = spark.createDataFrame([(0, 3, 0.1), (1, 4, 0.2)], "run_id int, updater int, rate double")
    assert history.loss_curves(table, runs).count() == 1000
