"""Features, control series, scoring, evaluation, samples."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import as_sparse, four_rows, random_rows

from slopeworks.operators import control, evaluate, features, sampling
from slopeworks.operators.gradient import prepare
from slopeworks.plans.model import LinearModel

NAN = float("nan")


def test_bias_is_the_last_feature(spark):
    assert [r["features"] for r in features.append_bias(four_rows(spark)).collect()][1] == [2.0, -1.0, 1.0]


def test_scaling(spark):
    rows = four_rows(spark).selectExpr("label", "concat(features, array(3.0D)) AS features")
    sd = features.column_stddev(rows, 3)
    got = [r["sd"] for r in sd.orderBy("idx").collect()]
    np.testing.assert_allclose(got, [1.2909944487, 1.2909944487, 0.0], atol=1e-10)
    first = features.scaled(rows, sd, 3).filter("features[0] > 0 AND features[1] > 0").first()["features"]
    np.testing.assert_allclose(first, [0.7745966692, 1.5491933385, 0.0], atol=1e-10)


def test_sparse_and_long_form_deviations_equal_dense_ones(spark, monkeypatch):
    rows = random_rows(spark, 200, 5)
    want = [r["sd"] for r in features.column_stddev(rows, 5).orderBy("idx").collect()]
    sparse = [r["sd"] for r in features.column_stddev(as_sparse(rows), 5).orderBy("idx").collect()]
    monkeypatch.setattr(features, "NARROW_WIDTH", 2)
    long = [r["sd"] for r in features.column_stddev(rows, 5).orderBy("idx").collect()]
    np.testing.assert_allclose(sparse, want, rtol=1e-10)
    np.testing.assert_allclose(long, want, rtol=1e-10)


def test_sparse_scaling(spark):
    rows = as_sparse(random_rows(spark, 100, 4))
    sd = features.column_stddev(rows, 4)
    divided = features.scaled(rows, sd, 4)
    again = [r["sd"] for r in features.column_stddev(divided, 4).collect()]
    np.testing.assert_allclose(again, 1.0, rtol=1e-10)


def test_unscaled_weights(spark):
    sd = spark.createDataFrame([(0, 2.0), (1, 0.0)], "idx int, sd double")
    params = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 7.0)], "idx int, w double")
    got = {r["idx"]: r["w"] for r in features.unscaled_weights(params, sd).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 7.0}


def test_label_check(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,), (NAN,)], "label double")
    assert features.bad_labels(rows).count() == 3


def test_early_stop_series(spark):
    def stop(values, warm_up=2):
        rows = [(0, i, v) for i, v in enumerate(values, 1)]
        table = spark.createDataFrame(rows, "config_id int, iteration int, val_loss double")
        found = control.early_stops(table, warm_up).first()
        return found["stop_iteration"] if found else None

    assert stop([0.9, 0.8, 0.7, 0.7, 0.6]) == 4
    assert stop([0.9, 0.8, NAN, 0.7]) == 3
    assert stop([0.9, NAN, 0.8]) == 3
    assert stop([0.9, 1.0, 0.8, 0.7]) is None
    assert control.must_stop(4, 2, 0.7, 0.7) and not control.must_stop(2, 2, 1.0, 0.5)
    assert control.must_stop(3, 2, NAN, 0.5) and control.must_stop(3, 2, 0.5, NAN)


def test_convergence(spark):
    assert control.has_converged(0.0009, 0.5, 0.001)
    assert control.has_converged(0.0015, 2.0, 0.001)
    assert not control.has_converged(0.0, 1.0, 0.0)
    assert not control.has_converged(NAN, 1.0, 0.5) and not control.has_converged(0.1, NAN, 0.5)
    rows = [(0, 1, 0, 1.0), (0, 2, 0, 1.0), (0, 1, 1, 0.0), (0, 2, 1, 0.5), (1, 1, 0, NAN), (1, 2, 0, NAN)]
    table = spark.createDataFrame(rows, "config_id int, iteration int, idx int, w double")
    found = {r["config_id"]: r for r in control.convergence_norms(table, 0.5).collect()}
    assert found[0]["change_norm"] == 0.5 and found[0]["iteration"] == 2 and found[0]["converged"]
    assert not found[1]["converged"]


def test_prediction_ties_and_nan_are_class_zero(spark):
    rows = spark.createDataFrame([(0.0, [0.0]), (0.0, [NAN]), (1.0, [1.0])], "label double, features array<double>")
    for loss in ("logistic", "hinge"):
        model = LinearModel(np.array([1.0]), 0.0, loss)
        assert [r["prediction"] for r in model.transform(rows).collect()] == [0.0, 0.0, 1.0]
        assert [model.predict_one(x) for x in ([0.0], [NAN], [1.0])] == [0.0, 0.0, 1.0]


def test_threshold(spark):
    strict = LinearModel(np.array([1.0]), 0.0, "logistic", threshold=0.9)
    assert strict.predict_one([1.0]) == 0.0 and strict.predict_one([5.0]) == 1.0


def test_wide_and_sparse_scoring_equal_narrow(spark):
    rows = random_rows(spark, 100, 6)
    model = LinearModel(np.linspace(-1, 1, 6), 0.3)
    padded = rows.selectExpr("label", "concat(features, array_repeat(0.0D, 40)) AS features", "row_key")
    wide_model = LinearModel(np.append(model.weights, np.ones(40)), 0.3)

    def margins(frame, m):
        return [r["margin"] for r in m.transform(frame).orderBy("row_key").collect()]

    want = margins(rows, model)
    np.testing.assert_allclose(margins(padded, wide_model), want, atol=1e-12)
    np.testing.assert_allclose(margins(as_sparse(rows), model), want, atol=1e-12)


def test_evaluation(spark):
    rows = random_rows(spark, 300, 4)
    models = [
        LinearModel(np.array([1.0, 1.0, 0.0, -1.0]), 0.0, loss, t) for loss in ("logistic", "hinge") for t in (None, 0.3)
    ]
    counted = {(r["config_id"], r["label"], r["prediction"]): r["n"]
               for r in evaluate.confusion_of(prepare(rows, 4), models).collect()}
    accuracies = {r["config_id"]: r["accuracy"] for r in evaluate.accuracy_of(prepare(rows, 4), models).collect()}
    for i, model in enumerate(models):
        scored = model.transform(rows)
        assert evaluate.accuracy(scored).first()["accuracy"] == pytest.approx(accuracies[i])
        for r in evaluate.confusion(scored).collect():
            assert counted[i, r["label"], r["prediction"]] == r["n"]
    ones = rows.filter("label = 1").count() / 300
    assert evaluate.majority_accuracy(rows).first()["accuracy"] == pytest.approx(max(ones, 1 - ones))


def test_samples(spark):
    rows = random_rows(spark, 4000, 2)
    batch = sampling.minibatch(rows, 1, 0.25)
    assert 900 < batch.count() < 1100
    assert batch.count() == sampling.minibatch(rows.repartition(7), 1, 0.25).count()
    assert sampling.minibatch(rows, 1, 1.0).count() == 4000
    train, held = sampling.train_validation(rows, 0.25)
    assert train.count() + held.count() == 4000 and 900 < held.count() < 1100
    assert sampling.train_validation(rows, 0.0)[1].count() == 0


def test_batches_of_different_iterations_are_independent(spark):
    from pyspark.sql import functions as F

    from slopeworks.functions.sampling import in_batch, key_word

    rows = spark.range(40000).select(F.col("id").cast("string").alias("row_key"))
    word = key_word(F.col("row_key"))
    drawn = rows.select(*[in_batch(word, i, 0.25).cast("int").alias(f"b{i}") for i in range(1, 7)])
    share = lambda *names: F.avg(np.prod([F.col(n) for n in names]))
    names = drawn.columns
    single = drawn.agg(*[share(n) for n in names]).first()
    pairs = drawn.agg(*[share(a, b) for a in names for b in names if a < b]).first()
    triples = drawn.agg(*[share(a, b, c) for a in names for b in names for c in names if a < b < c]).first()
    np.testing.assert_allclose(single, 0.25, atol=0.01)
    np.testing.assert_allclose(pairs, 0.0625, atol=0.006)
    np.testing.assert_allclose(triples, 0.015625, atol=0.004)


def test_model_round_trip(spark, tmp_path):
    model = LinearModel(np.array([0.5, -1.5]), 0.25, "hinge")
    model.save(spark, str(tmp_path / "m"))
    back = LinearModel.load(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(back.weights, model.weights)
    assert (back.intercept, back.loss, back.cut) == (0.25, "hinge", 0.0)
