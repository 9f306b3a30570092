"""One answer whatever the layout, the size or the state of the rows."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import as_sparse, random_rows

from slopeworks import SgdConfig, fit, sweep, sweep_configs
from slopeworks.operators import evaluate
from slopeworks.operators import gradient as gradient_module
from slopeworks.operators.gradient import prepare
from slopeworks.plans import fit as fit_module
from slopeworks.plans.fit import accuracies
from slopeworks.plans.model import LinearModel

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")

DIRTY = [
    (1.0, [1.0, None], "a"), (0.0, [2.0, -1.0], "b"), (1.0, [0.0, 1.0], None), (0.0, [-1.0, 0.0], "d"), (None, [5.0, 5.0], "e"),
]
DIRTY_SPARSE = [
    (1.0, [0, 1], [1.0, None], "a"), (0.0, [0, 1, -4], [2.0, -1.0, 9.0], "b"), (1.0, [1, None], [1.0, 7.0], None),
    (0.0, [0, 1], [-1.0], "d"), (None, [0], [5.0], "e"),
]


def plain(**changes):
    return SgdConfig(**({"updater": "simple", "num_iterations": 3, "convergence_tol": 0.0, "validate": False} | changes))


def dirty(spark, sparse=False):
    if sparse:
        return spark.createDataFrame(DIRTY_SPARSE, "label double, idx array<int>, val array<double>, row_key string")
    return spark.createDataFrame(DIRTY, "label double, features array<double>, row_key string")


@pytest.mark.parametrize("fraction,split", [(1.0, 0.0), (0.6, 0.2)])
def test_unclean_rows_mean_the_same_in_every_layout(spark, fraction, split):
    """A null element is 0; a row without a label is not there; a row without a key is in no batch."""
    config = plain(mini_batch_fraction=fraction, validation_split=split, intercept=True)
    found = [fit(dirty(spark), config, num_features=2, layout=x)[0] for x in ("columns", "arrow", "join")]
    found += [fit(dirty(spark, True), config, num_features=2, layout=x)[0] for x in ("arrow", "join")]
    found.append(fit(dirty(spark), config, num_features=2)[0])
    for other in found[1:]:
        np.testing.assert_allclose(other.model.weights, found[0].model.weights, atol=1e-12)
        assert [s.batch_n for s in other.steps] == [s.batch_n for s in found[0].steps]
        np.testing.assert_allclose(other.losses, found[0].losses, atol=1e-12)
    assert found[0].steps[0].batch_n == 4 or fraction < 1


@pytest.mark.parametrize(
    "row,message",
    [
        ((1.0, [0], [None], "k"), "null elements"), ((1.0, [-1], [1.0], "k"), "null elements"),
        ((1.0, [0, 1], [1.0], "k"), "null elements"), ((1.0, [None], [1.0], "k"), "null elements"),
        ((1.0, [0], [1.0], None), "no key"), ((None, [0], [1.0], "k"), "labels"), ((2.0, [0], [1.0], "k"), "labels"),
    ],
)
@pytest.mark.parametrize("layout", ["auto", "join"])
def test_validation_finds_unclean_rows(spark, row, message, layout):
    rows = spark.createDataFrame([(0.0, [1], [2.0], "x"), row], "label double, idx array<int>, val array<double>, row_key string")
    with pytest.raises(ValueError, match=f"Input validation failed.*{message}"):
        fit(rows, plain(validate=True), num_features=2, layout=layout)


def test_a_dense_null_is_found_in_narrow_and_wide_rows(spark):
    for width in (2, 40):
        rows = spark.createDataFrame([(1.0, [1.0] * (width - 1) + [None])], "label double, features array<double>")
        with pytest.raises(ValueError, match="null elements"):
            fit(rows, plain(validate=True), num_features=width)


def test_unkeyed_batches_do_not_depend_on_the_layout(spark):
    rows = random_rows(spark, 3000, 4).drop("row_key")
    config = plain(mini_batch_fraction=0.25, validation_split=0.2, validate=True)
    found = [fit(rows, config, num_features=4, layout=x)[0] for x in ("columns", "arrow", "join")]
    for other in found[1:]:
        assert [s.batch_n for s in other.steps] == [s.batch_n for s in found[0].steps]
        np.testing.assert_allclose(other.losses, found[0].losses, atol=1e-12)


def test_sizes_change_no_result(spark, monkeypatch):
    """Spread or not, columns or arrow, one group of configurations or many: the same steps."""
    rows = random_rows(spark, 800, 4)
    configs = [plain(updater=u, mini_batch_fraction=0.5, validation_split=0.2, validate=True) for u in ("simple", "adam", "adagrad")]
    near = fit(rows, configs, num_features=4)
    monkeypatch.setattr(gradient_module, "_SMALL_BYTES", -1)
    middle = fit(rows, configs, num_features=4)  # spread after it is prepared
    monkeypatch.setattr(gradient_module, "_SMALL_VALUES", 10)
    monkeypatch.setattr(gradient_module, "_COLUMN_ROWS", 10)
    monkeypatch.setattr(fit_module, "MAX_DRIVER_VALUES", 9)  # one configuration at a time, still broadcast
    far = fit(rows, configs, num_features=4)
    for a, b in [*zip(near, far), *zip(near, middle)]:
        np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-12)
        assert [s.batch_n for s in a.steps] == [s.batch_n for s in b.steps]
        assert isinstance(b.model, LinearModel)


@pytest.mark.parametrize("case", ["narrow", "scaled", "sparse", "sampled", "join", "score"])
def test_the_source_is_read_once(spark, case):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = random_rows(spark, 500, 3)
    rows = as_sparse(rows) if case in ("sparse", "join") else rows
    source = rows.mapInArrow(count, rows.schema)
    settings = {"scaled": {"scale": True}, "sampled": {"mini_batch_fraction": 0.5, "validation_split": 0.2}}.get(case, {})
    fit(source, plain(validate=True, **settings), 3, layout="join" if case == "join" else "auto", score=case == "score")
    assert seen.value == 500


def test_tables_are_released_after_success_and_after_an_error(spark):
    persistent = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = persistent()
    fit(random_rows(spark, 100, 2), plain(), 2)
    assert persistent() == before
    with pytest.raises(ValueError):
        fit(dirty(spark), plain(validate=True), 2)
    assert persistent() == before


def test_losses_are_told_as_the_fit_runs(spark):
    told = []

    def stop_at_three(place, step):
        told.append((place, step.iteration, step.train_loss))
        if len(told) == 6:
            raise RuntimeError("lost")

    configs = [plain(updater=u, num_iterations=9) for u in ("simple", "adam")]
    with pytest.raises(RuntimeError, match="lost"):
        fit(random_rows(spark, 100, 2), configs, 2, on_step=stop_at_three)
    assert [x[:2] for x in told] == [(0, 1), (1, 1), (0, 2), (1, 2), (0, 3), (1, 3)]
    whole = fit(random_rows(spark, 100, 2), configs, 2)
    assert [x[2] for x in told[::2]] == pytest.approx(whole[0].losses[:3])


def test_accuracies_tell_labels_apart(spark):
    """Both ways to score agree on labels that are neither 0 nor 1."""
    rows = spark.createDataFrame(
        [(1.0, [2.0]), (-1.0, [3.0]), (None, [1.0]), (2.0, [1.0]), (0.0, [-1.0])], "label double, features array<double>"
    )
    model = LinearModel(np.array([1.0]), 0.0, "hinge")
    whole = evaluate.accuracy(model.transform(rows)).first()["accuracy"]
    assert whole == 0.5 and accuracies(prepare(rows, 1), [model]) == [0.5]
    counts = {tuple(r) for r in evaluate.confusion_of(prepare(rows, 1), [model]).collect()}
    assert counts == {(0, *tuple(r)) for r in evaluate.confusion(model.transform(rows)).collect()}


def test_sweep_scores_indices_beyond_the_training_width(spark):
    train = as_sparse(random_rows(spark, 300, 3))
    test = train.unionByName(
        spark.createDataFrame([(1.0, [0, 9], [0.5, 4.0], "far")], "label double, idx array<int>, val array<double>, row_key string")
    )
    base = plain(num_iterations=2, validate=True)
    found = sweep(train, test, sweep_configs(base, updaters=("simple", "adam"), variations=(0.0,)))
    for result, row in zip(found.results, found.runs.orderBy("run_id").collect()):
        assert row["test_acc"] == pytest.approx(evaluate.accuracy(result.model.transform(test)).first()["accuracy"])


def test_rows_without_a_vector_are_scored(spark):
    for width in (2, 40):
        model = LinearModel(np.ones(width), 0.5)
        rows = spark.createDataFrame([(1, [1.0] * width), (2, None), (3, [0.0] * width)], "i int, features array<double>").coalesce(1)
        found = {r["i"]: (r["margin"], r["prediction"]) for r in model.transform(rows).collect()}
        assert found == {1: (width + 0.5, 1.0), 2: (None, 0.0), 3: (0.5, 1.0)}
    rows = spark.createDataFrame([(1, [0], [2.0]), (2, None, None), (3, [], [])], "i int, idx array<int>, val array<double>").coalesce(1)
    found = {r["i"]: (r["margin"], r["prediction"]) for r in LinearModel(np.ones(3), -1.0).transform(rows).collect()}
    assert found == {1: (1.0, 1.0), 2: (None, 0.0), 3: (-1.0, 0.0)}


def test_uneven_dense_rows_are_refused(spark):
    rows = spark.createDataFrame([(1.0, [1.0] * 40), (0.0, [1.0] * 39)], "label double, features array<double>").coalesce(1)
    with pytest.raises(ValueError, match="feature widths"):
        fit(rows, plain(), num_features=40)
