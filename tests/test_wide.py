"""Weights kept as a table, with hot indices."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks import SgdConfig, fit
from slopeworks.operators import features, joined
from slopeworks.plans import fit as fit_module
from slopeworks.plans import wide
from slopeworks.plans.model import LinearModel
from slopeworks.shared import settled, shared_root

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")


def skewed_rows(spark, n=600, width=50):
    """Index 0 holds a third of all entries; some rows have none."""
    entries = F.expr(f"array_sort(array_distinct(array(0, cast(id % {width} as int), cast(id * 7 % {width} as int))))")
    idx = F.when(F.col("id") % 50 == 3, F.array().cast("array<int>")).otherwise(entries)
    rows = spark.range(n).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"),
        idx.alias("idx"),
        F.transform(idx, lambda i: (i % 5 + 1).cast("double")).alias("val"),
        F.col("id").cast("string").alias("row_key"),
    )
    return rows


def weights_of(spark):
    return spark.range(50).select(F.col("id").cast("int").alias("idx"), (F.col("id") / 10.0).alias("w"))


def test_every_grid_gives_the_same_margins(spark):
    rows = joined.identified(skewed_rows(spark))
    found = []
    for grid in (joined.Grid((1,)), joined.Grid((7,)), joined.Grid((1,) * 50), joined.Grid((9, 1, 3, 2)), joined.grid_of(rows, 50)):
        margins = joined.table_margins(joined.entries_of(rows, grid), weights_of(spark), [F.col("w"), -F.col("w")], grid)
        found.append({r["row_id"]: (r["m_0"], r["m_1"]) for r in margins.collect()})
    want = {}
    for row in rows.filter("size(idx) > 0").collect():
        want[row["row_id"]] = sum(i / 10.0 * v for i, v in zip(row["idx"], row["val"]))
    for margins in found:
        assert margins.keys() == want.keys()
        assert all(margins[k] == pytest.approx((want[k], -want[k])) for k in want)


def test_a_hot_block_is_cut_into_ways_and_a_row_has_one_part_a_block(spark):
    rows = joined.identified(skewed_rows(spark))
    grid = joined.grid_of(rows, 50)
    entries = joined.entries_of(rows, grid)
    total, parts = entries.count(), entries.groupBy("part").count().collect()
    assert len(parts) >= joined.partitions_of(rows)
    assert max(r["count"] for r in parts) < 1.5 * total / joined.partitions_of(rows)
    blocks = len(grid.ways)
    most = entries.groupBy("row_id").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0]
    assert most <= blocks


def test_no_join_of_wide_scoring_has_a_constant_key_or_weights_in_every_task(spark, monkeypatch):
    """Without broadcasts: rows move by row id only, entries by part only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = skewed_rows(spark).withColumn("about", F.create_map(F.lit("a"), F.col("row_key")))
        model = wide.TableModel(weights_of(spark), 0.5, "logistic", 50)
        near = LinearModel(np.arange(50) / 10.0, 0.5, "logistic")
        far = model.transform(rows)
        plan = far._jdf.queryExecution().executedPlan().toString()
        keys = {line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line}
        assert keys <= {"part", "row_id"} and "Broadcast" not in plan
        a = {r["row_key"]: (r["margin"], r["prediction"], r["about"]) for r in far.collect()}
        b = {r["row_key"]: (pytest.approx(r["margin"]), r["prediction"], r["about"]) for r in near.transform(rows).collect()}
        assert a == b
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_confusion_counts_of_models_with_tables(spark):
    rows = skewed_rows(spark).withColumn("label", F.when(F.col("row_key") == "3", 7.0).otherwise(F.col("label")))
    models = [wide.TableModel(weights_of(spark), b, "logistic", 50) for b in (-0.5, -9.0)]
    counted = {tuple(r)[:3]: r["n"] for r in wide.table_confusion(rows, models).collect()}
    want = {}
    for k, model in enumerate(models):
        near = LinearModel(np.arange(50) / 10.0, model.intercept, "logistic")
        for r in near.transform(rows).groupBy("label", "prediction").count().collect():
            want[(k, r["label"], r["prediction"])] = r["count"]
    assert counted == want


def test_table_weights_equal_broadcast_weights(spark):
    configs = [
        SgdConfig(updater=u, num_iterations=4, convergence_tol=0.0, step_size=0.2, intercept=True, reg_type=1,
                  reg_param=0.001, semantics="standard")
        for u in ("simple", "nesterov", "adadelta", "adamax", "nadam", "amsgrad", "adam", "adagrad", "rmsprop")
    ]
    rows = skewed_rows(spark)
    near, far = (fit(rows, configs, num_features=50, layout=layout) for layout in ("arrow", "join"))
    for a, b in zip(near, far):
        np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-10)
        np.testing.assert_allclose(a.losses, b.losses, atol=1e-10)


def test_the_bound_decides(spark, monkeypatch):
    """Past the bound the weights are never collected, and scoring joins them."""
    rows = skewed_rows(spark)
    config = SgdConfig(updater="adagrad", num_iterations=3, convergence_tol=0.0, intercept=True)
    near = fit(rows, config, num_features=50)[0]
    for module in (fit_module, wide, features):
        monkeypatch.setattr(module, "MAX_DRIVER_VALUES", 40)
    far = fit(rows, config, num_features=50)[0]
    assert isinstance(far.model, wide.TableModel)
    got = {r["idx"]: r["w"] for r in far.model.weights.collect()}
    np.testing.assert_allclose([got[j] for j in range(50)], near.model.weights, atol=1e-10)
    scored = far.model.transform(rows)
    assert scored.columns == near.model.transform(rows).columns
    a = {r["row_key"]: r for r in near.model.transform(rows).collect()}
    b = {r["row_key"]: r for r in scored.collect()}
    assert a.keys() == b.keys() and len(a) == 600
    for key, row in a.items():
        assert row["prediction"] == b[key]["prediction"] and row["idx"] == b[key]["idx"] and row["val"] == b[key]["val"]
        assert row["probability"] == pytest.approx(b[key]["probability"])
    with pytest.raises(ValueError, match="driver vector"):
        features.collect_vector(far.model.weights, "w", 50)


def test_start_as_a_table(spark):
    rows = skewed_rows(spark)
    start = spark.range(50).select(F.col("id").cast("int").alias("idx"), (F.col("id") / 100.0).alias("w"))
    config = SgdConfig(updater="momentum", num_iterations=3, convergence_tol=0.0, reg_type=2, reg_param=0.1)
    near = fit(rows, config, num_features=50, initial_weights=[j / 100.0 for j in range(50)])[0]
    for layout in ("arrow", "join"):
        far = fit(rows, config, num_features=50, initial_weights=start, layout=layout)[0]
        np.testing.assert_allclose(far.model.weights, near.model.weights, atol=1e-12)
        np.testing.assert_allclose(far.losses, near.losses, atol=1e-12)


def test_batches_without_a_key(spark):
    """The row ids stand in for keys, so a fit keyed by them agrees."""
    rows = skewed_rows(spark, n=2000).drop("row_key")
    config = SgdConfig(num_iterations=3, mini_batch_fraction=0.25, validation_split=0.2, convergence_tol=0.0)
    far = fit(rows, config, num_features=50, layout="join")[0]
    keyed = rows.withColumn("row_key", F.monotonically_increasing_id().cast("string"))
    near = fit(keyed, config, num_features=50, layout="arrow")[0]
    assert [s.batch_n for s in far.steps] == [s.batch_n for s in near.steps]
    assert all(300 < s.batch_n < 500 for s in far.steps)
    np.testing.assert_allclose(far.model.weights, near.model.weights, atol=1e-12)
    np.testing.assert_allclose([s.val_loss for s in far.steps], [s.val_loss for s in near.steps], atol=1e-12)


def test_table_model_is_a_whole_model(spark, tmp_path):
    weights = spark.createDataFrame([(0, 0.5), (2, -1.0)], "idx int, w double")
    model = wide.TableModel(weights, 0.25, "logistic", 3, threshold=0.6)
    dense = spark.createDataFrame([("a", [1.0, 2.0, 0.5]), ("b", [3.0, 0.0, 0.0]), ("c", None)], "name string, features array<double>")
    near = LinearModel(np.array([0.5, 0.0, -1.0]), 0.25, "logistic", 0.6)
    assert sorted(map(str, model.transform(dense).collect())) == sorted(map(str, near.transform(dense).collect()))
    assert model.predict_one([3.0, 0.0, 0.0]) == near.predict_one([3.0, 0.0, 0.0]) == 1.0
    model.save(spark, str(tmp_path / "m"))
    back = wide.TableModel.load(spark, str(tmp_path / "m"))
    assert (back.intercept, back.loss, back.num_features, back.cut) == (0.25, "logistic", 3, 0.6)
    assert sorted(map(tuple, back.weights.collect())) == [(0, 0.5), (2, -1.0)]
    assert sorted(map(tuple, model.params(spark).collect())) == [(0, 0.5, False), (2, -1.0, False), (3, 0.25, True)]
    assert "threshold=0.6" in repr(model)


def test_a_long_fit_leaves_its_last_weights_only(spark):
    folder = shared_root(spark).removeprefix("file:")
    kept = lambda: {n for n in os.listdir(folder) if n.startswith(("weights-", "gradient-"))}
    before = kept()
    configs = [SgdConfig(updater=u, num_iterations=6, convergence_tol=0.0) for u in ("simple", "adam")]
    fit(skewed_rows(spark), configs, num_features=50, layout="join")
    assert len(kept() - before) <= 1


def test_many_models_with_tables_are_scored_in_one_join(spark, monkeypatch):
    rows = skewed_rows(spark)
    configs = [SgdConfig(updater=u, num_iterations=2, convergence_tol=0.0) for u in ("simple", "adagrad")]
    near = fit(rows, configs, num_features=50, score=True)
    for module in (fit_module, wide, features):
        monkeypatch.setattr(module, "MAX_DRIVER_VALUES", 40)
    far = fit(rows, configs, num_features=50, score=True)
    assert all(isinstance(r.model, wide.TableModel) for r in far)
    assert [r.train_accuracy for r in far] == pytest.approx([r.train_accuracy for r in near])


def test_scaling_beyond_the_bound_joins(spark, monkeypatch):
    sparse = skewed_rows(spark).withColumn("val", F.transform("val", lambda x: x + F.col("row_key").cast("double")))
    dense = sparse.select("row_key", F.array(*[F.col("row_key").cast("double") * j for j in range(4)]).alias("features"))
    for rows, width in ((sparse, 50), (dense, 4)):
        sd = features.column_stddev(rows, width)
        near = {r["row_key"]: r for r in features.scaled(rows, sd, width).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(features, "MAX_DRIVER_VALUES", 3)
            far = {r["row_key"]: r for r in features.scaled(rows, sd, width).collect()}
        assert near.keys() == far.keys()
        name = "val" if width == 50 else "features"
        for key, row in near.items():
            assert row[name] == pytest.approx(far[key][name])


def test_entries_stay_where_they_are_in_an_iteration(spark):
    """Once spread and persisted, neither entries nor rows are exchanged when margins and gradient are made."""
    rows = joined.spread_by_id(joined.identified(skewed_rows(spark))).persist()
    grid = joined.grid_of(rows, 50)
    entries = joined.spread_by_part(joined.entries_of(rows, grid)).persist()
    entries.count()
    params = settled(weights_of(spark))
    margins = joined.table_margins(entries, params, [F.col("w")], grid)
    sums = joined.table_gradient(rows, margins, ["logistic"], [0.0])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    lines, moved = plan.splitlines(), []
    depth_of = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = lines[k + 1 : k + 4]
            moved.append((line.split("hashpartitioning(")[1].split("#")[0], any("InMemoryTableScan" in x for x in below)))
            assert depth_of(lines[k + 1]) >= depth_of(line)
    before_cache = [m for m in moved if m[0] in ("part", "row_id", "idx")]
    assert ("part", True) not in before_cache and ("row_id", True) not in before_cache
    entries.unpersist()
    rows.unpersist()
