"""Run logs as text: loss lines, each run closed by one summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeworks.shared import settled

# The two line formats of a run log (the double space is part of the format).
LOSS_START, SUMMARY_START = "Loss in iteration ", "Testing accuracy  of updater "
LOSS_LINE = r"^Loss in iteration (\d+) : (\S+)\s*$"
SUMMARY_LINE = (
    r"^Testing accuracy  of updater (\S+) on alg (\S+) with rate (\S+) = (\S+), "
    r"training accuracy (\S+), time elapsed: (\d+) millisecond\.\s*$"
)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with their place: ``(source, block, seq, value)``.

    A block is one split of a file, so it is bounded by the split size; rows of a split keep their
    order in ``seq``.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _is_loss(value: Column) -> Column:
    """The plain prefix is tested first: most lines need no second pattern."""
    return value.startswith(LOSS_START) & value.rlike(LOSS_LINE)


def _is_summary(value: Column) -> Column:
    return value.startswith(SUMMARY_START) & value.rlike(SUMMARY_LINE)


def _summary(value: Column) -> Column:
    part = lambda i: F.regexp_extract(value, SUMMARY_LINE, i)
    return F.when(
        _is_summary(value),
        F.struct(
            part(1).try_cast("int").alias("updater"),
            part(2).alias("alg"),
            part(3).cast("double").alias("rate"),
            part(4).cast("double").alias("test_acc"),
            part(5).cast("double").alias("train_acc"),
            part(6).cast("bigint").alias("elapsed_ms"),
        ),
    )


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Every recognised line with its run: ``(source, run_id, iteration, loss, is_summary,
    updater, alg, rate, test_acc, train_acc, elapsed_ms)``.

    A run's lines precede its summary line; lines after the last summary belong to no run and are
    dropped, as are lines in other formats.  Runs are numbered from 0 within a source.

    Numbering needs the order of all lines.  It is done per block (bounded) plus one small row per
    block for what the later blocks hold, so no file passes through a single task.
    """
    value = F.col("value")
    summary = _summary(value)
    is_loss = _is_loss(value)
    # Cut the lines down to what the formats carry, once for the two uses that follow.
    known = settled(
        lines.filter(is_loss | _is_summary(value))
        .select(
            "source",
            "block",
            "seq",
            F.when(is_loss, F.regexp_extract(value, LOSS_LINE, 1).cast("int")).alias("iteration"),
            F.when(is_loss, F.regexp_extract(value, LOSS_LINE, 2).cast("double")).alias("loss"),
            summary.alias("summary"),
        )
    )
    closes = F.col("summary").isNotNull()
    blocks = known.groupBy("source", "block").agg(
        F.count_if(closes).alias("in_block"),
        F.min_by("summary", F.when(closes, F.col("seq"))).alias("opening"),
    )
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("source").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select(
        "source",
        "block",
        (F.coalesce(F.sum("in_block").over(ahead), F.lit(0)) + F.col("in_block")).alias("through"),
        F.last("opening", ignorenulls=True).over(behind).alias("later"),
    )
    # Backwards through a block: the nearest summary at or after a line, and how many there are.
    onward = (
        Window.partitionBy("source", "block")
        .orderBy(F.col("seq").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = known.select(
        "source",
        "block",
        "iteration",
        "loss",
        closes.alias("is_summary"),
        F.last("summary", ignorenulls=True).over(onward).alias("nearest"),
        F.count_if(closes).over(onward).alias("remaining"),
    ).join(places, ["source", "block"])
    run = F.coalesce("nearest", "later")
    return (
        placed.withColumn("run", run)
        .filter(F.col("run").isNotNull())
        .select(
            "source",
            (F.col("through") - F.col("remaining")).alias("run_id"),
            "iteration",
            "loss",
            "is_summary",
            "run.*",
        )
    )


def log_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a parsed log into ``history`` and ``runs``."""
    history = parsed.filter(~F.col("is_summary")).select(
        "source", "run_id", "updater", "alg", "rate", "iteration", "loss"
    )
    runs = parsed.filter("is_summary").select(
        "source", "run_id", "updater", "alg", "rate", "test_acc", "train_acc", "elapsed_ms"
    )
    return history, runs


def run_log_lines(history: DataFrame, runs: DataFrame) -> DataFrame:
    """The text form of ``history`` and ``runs`` with ``(run_id, position)`` to sort it by."""
    loss = F.format_string("Loss in iteration %d : %s", F.col("iteration"), F.col("loss").cast("string"))
    losses = history.select("run_id", F.col("iteration").alias("position"), loss.alias("value"))
    closing = F.format_string(
        "Testing accuracy  of updater %s on alg %s with rate %s = %s, training accuracy %s, "
        "time elapsed: %d millisecond.",
        *[F.col(c).cast("string") for c in ("updater", "alg", "rate", "test_acc", "train_acc")],
        F.col("elapsed_ms"),
    )
    summaries = runs.select("run_id", F.lit(2**31 - 1).alias("position"), closing.alias("value"))
    return losses.unionByName(summaries)
