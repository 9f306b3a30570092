"""Snapshots of a fit in a shared folder, from which a later fit goes on.

A snapshot holds everything an iteration changes: weights, updater state, the place of the next gradient, the
penalty, the number of updates, validation losses and the history.  Batches depend on the iteration alone, so a fit
taken up again gives the results of an unbroken one.  The last complete snapshot counts; earlier ones are removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from slopeworks.shared import removed

if TYPE_CHECKING:
    from slopeworks.plans.fit import _Run

_VECTOR = pa.list_(pa.float64())
_SCHEMA = pa.schema(
    [
        ("place", pa.int32()),
        ("about", pa.string()),
        ("weights", _VECTOR),
        ("state", pa.list_(_VECTOR)),
        ("look_ahead", _VECTOR),
        ("penalty", pa.float64()),
        ("updates", pa.int64()),
        ("val_losses", _VECTOR),
        ("steps", pa.list_(pa.struct([("iteration", pa.int32()), ("train_loss", pa.float64()), ("val_loss", pa.float64()), ("batch_n", pa.int64())]))),
        ("stop_reason", pa.string()),
    ]
)


@dataclass(frozen=True)
class Snapshots:
    """Where snapshots lie (a folder that outlives the driver) and after how many iterations each is taken."""

    path: str
    every: int = 10

    def __post_init__(self) -> None:
        if self.every < 1:
            raise ValueError("every must be 1 or more")

    def of_group(self, first: int) -> "Snapshots":
        """Configurations that are fitted together have a folder of their own."""
        return Snapshots(f"{self.path}/{first}", self.every)


def _about(run: "_Run") -> str:
    """What must be the same for a fit to go on: all settings but the number of iterations."""
    return f"{run.config.with_(num_iterations=1)} weights={len(run.weights)}"


def _iterations(spark: SparkSession, path: str) -> list[int]:
    """Iterations with a complete snapshot, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def save(spark: SparkSession, snapshots: Snapshots, runs: list["_Run"], iteration: int) -> None:
    """Write the state after an iteration, then remove earlier snapshots."""
    rows = [
        {
            "place": place,
            "about": _about(run),
            "weights": run.weights,
            "state": [s.tolist() for s in run.state],
            "look_ahead": run.look_ahead,
            "penalty": run.penalty,
            "updates": run.updates,
            "val_losses": run.val_losses,
            "steps": [vars(step) for step in run.steps],
            "stop_reason": run.stop_reason,
        }
        for place, run in enumerate(runs)
    ]
    earlier = _iterations(spark, snapshots.path)
    table = spark.createDataFrame(pa.Table.from_pylist(rows, _SCHEMA)).coalesce(1)
    table.write.mode("overwrite").parquet(f"{snapshots.path}/{iteration}")
    for old in earlier:
        if old != iteration:
            removed(spark, f"{snapshots.path}/{old}")


def restore(spark: SparkSession, snapshots: Snapshots, runs: list["_Run"]) -> int:
    """Bring runs to the last snapshot; its iteration, 0 if there is none."""
    from slopeworks.plans.fit import Step

    found = _iterations(spark, snapshots.path)
    if not found:
        return 0
    rows = spark.read.parquet(f"{snapshots.path}/{found[-1]}").toArrow().to_pylist()
    by_place = {row["place"]: row for row in rows}
    if set(by_place) != set(range(len(runs))) or any(by_place[k]["about"] != _about(run) for k, run in enumerate(runs)):
        raise ValueError(f"the snapshot in {snapshots.path} is of a fit with other settings")
    for place, run in enumerate(runs):
        row = by_place[place]
        run.weights = np.array(row["weights"], float)
        run.state = tuple(np.array(s, float) for s in row["state"])
        run.look_ahead = None if row["look_ahead"] is None else np.array(row["look_ahead"], float)
        run.penalty, run.updates, run.val_losses = row["penalty"], row["updates"], list(row["val_losses"])
        run.steps = [Step(**step) for step in row["steps"]]
        run.stop_reason = row["stop_reason"]
        # A fit that had come to its end goes on if it is given more iterations.
        if run.stop_reason == "max_iterations" and run.config.num_iterations > found[-1]:
            run.stop_reason = None
    return found[-1]
