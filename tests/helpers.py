from __future__ import annotations

T4 = [(1.0, [1.0, 2.0]), (0.0, [2.0, -1.0]), (1.0, [0.0, 1.0]), (0.0, [-1.0, 0.0])]


def four_rows(spark):
    return spark.createDataFrame(T4, "label double, features array<double>")


def as_sparse(df):
    return df.selectExpr(
        "label",
        "transform(filter(transform(features, (x, i) -> struct(i, x)), e -> e.x <> 0), e -> e.i) AS idx",
        "filter(features, x -> x <> 0) AS val",
        *[c for c in df.columns if c == "row_key"],
    )


def random_rows(spark, n: int, width: int, seed: int = 3, zeros: float = 0.5):
    """Learnable rows with a unique key, made by Spark."""
    from pyspark.sql import functions as F

    cells = [
        F.when(F.rand(seed * 1000 + j) < zeros, F.lit(0.0)).otherwise(F.round(F.randn(seed * 2000 + j), 3))
        for j in range(width)
    ]
    rows = spark.range(n, numPartitions=4).select(F.array(*cells).alias("features"), F.col("id"))
    noise = F.when(F.rand(seed) < 0.1, 1.0).otherwise(0.0)
    side = F.col("features")[0] + F.col("features")[1] - F.col("features")[width - 1] > noise
    frame = rows.select(
        side.cast("double").alias("label"), "features", F.col("id").cast("string").alias("row_key")
    )
    # materialised, so the expressions above are evaluated once
    return spark.createDataFrame(frame.toArrow())
