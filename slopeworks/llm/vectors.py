"""Operator 6: near duplicates among embeddings by product quantisation.

Equal vectors are one.  A coarse quantiser (spherical k-means) deals the distinct, normalised vectors to
inverted lists; a vector's residual from its list's centre is coded in ``SUBSPACES`` subspaces.  A vector
is looked up in every list its neighbours could be in: with cosine ``t`` neighbours lie within
``r = sqrt(2 - 2 t)``, and of two vectors on either side of the plane between two centres one lies within r / 2
of it, so lists whose plane is within ``REACH * r / 2`` are probed (REACH 1 is certain; at 0.6 the difference of
two neighbours would have to point at a centre with more than 0.6 of its length).  In a list, the distance to a
coded vector is read from per-subspace tables (asymmetric distance); the coded vector's own error, kept with
the code, bounds how far that can be off, so no neighbour is lost there.  What remains is decided by the exact
cosine in double precision.

The quantisers are fitted on at most ``SAMPLE`` vectors; every vector is indexed and looked up.  Lists are cut
into blocks, so a task holds ``MEMBERS`` members and ``QUERIES`` queries whatever the size of a list.
A block hands on a count of links per vector and a spanning forest of its links, never its pairs.

Null vectors, zero vectors, vectors with null or non-finite components and rows without an id link with
nothing.  Vectors of different length never link.  Rows that share an id are one vector in the links of
others.  Every input row gives one output row; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of
from slopeworks.llm.graph import components, join_spread
from slopeworks.shared import settled

THRESHOLD = 0.9
REACH = 0.6
SAMPLE = 20_000
SUBSPACES = 8
CODES = 64
MAX_LISTS = 2048
MEMBERS = 1024
QUERIES = 2048
_PAIRS = 1 << 17
_STEPS = 8


@dataclass
class Quantiser:
    """Unit centres of the lists, and the code book of every subspace (a range of components)."""

    centres: np.ndarray
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]

    def coded(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace, and the distance of each residual to what its codes stand for."""
        codes = np.empty((len(residuals), len(self.books)), np.uint8)
        left = np.zeros(len(residuals))
        for place, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            distances = _squares(residuals[:, a:b], book)
            codes[:, place] = distances.argmin(axis=1)
            left += np.maximum(distances.min(axis=1), 0)
        return codes, np.sqrt(left)

    def assigned(self, vectors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and which lists it is looked up in (its own among them)."""
        near = vectors @ self.centres.T
        own = near.argmax(axis=1)
        gaps = np.sqrt(np.maximum(2 - 2 * (self.centres @ self.centres.T), 1e-12))
        # Distance to the plane between the own and another centre.
        planes = (near[np.arange(len(near)), own][:, None] - near) / gaps[own]
        probed = planes <= reach
        probed[np.arange(len(near)), own] = True
        return own, probed


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None, :]


def _means(rows: np.ndarray, count: int, unit: bool, seed: int) -> np.ndarray:
    """k-means; with ``unit`` the centres are unit vectors."""
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(_STEPS):
        nearest = np.concatenate(
            [_squares(rows[k : k + 4096], centres).argmin(1) for k in range(0, len(rows), 4096)]
        )
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=len(centres))
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled][:, None]
        if unit:
            lengths = np.linalg.norm(centres, axis=1)
            centres[lengths > 0] /= lengths[lengths > 0][:, None]
    return centres


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> Quantiser:
    """Quantisers from a sample of unit vectors."""
    centres = np.unique(_means(sample, lists, True, seed), axis=0)
    own = np.concatenate([(sample[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(sample), 4096)])
    residuals = sample - centres[own]
    parts = [part for part in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(part)]
    cuts = [(int(part[0]), int(part[-1]) + 1) for part in parts]
    return Quantiser(centres, cuts, [_means(residuals[:, a:b], CODES, False, seed + a) for a, b in cuts])


def _read(vectors: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors as doubles, None for the others."""
    found = []
    for vector in vectors:
        if not vector.is_valid or not len(vector.values) or vector.values.null_count:
            found.append(None)
            continue
        own = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        length = np.linalg.norm(own)
        found.append(own if np.isfinite(own).all() and np.isfinite(length) and length > 0 else None)
    return found


def _rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, size, data``: components as packed doubles; null for unusable vectors."""

    def run(batches):
        for batch in batches:
            vectors = _read(column_of(batch, "vector"))
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "id"),
                    pa.array([None if v is None else len(v) for v in vectors], pa.int32()),
                    # Adding zero turns -0.0 into 0.0, so equal vectors have equal bytes.
                    pa.array([None if v is None else (v + 0.0).astype("<f8").tobytes() for v in vectors], pa.binary()),
                ],
                ["id", "size", "data"],
            )

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    return rows.mapInArrow(run, "id long, size int, data binary")


def _unit(data: list[bytes], size: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), "<f8").reshape(len(data), size)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _indexed(distinct: DataFrame, model, size: int, reach: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                vectors = _unit(column_of(part, "data").to_pylist(), size)
                own, probed = model.value.assigned(vectors, reach)
                codes, errors = model.value.coded(vectors - model.value.centres[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column_of(part, name) for name in ("id", "times", "data")),
                        pa.array(own.astype(np.int32)),
                        pa.array([np.flatnonzero(row).astype(np.int32) for row in probed], pa.list_(pa.int32())),
                        pa.array([row.tobytes() for row in codes], pa.binary()),
                        pa.array(errors),
                    ],
                    ["id", "times", "data", "list", "probes", "codes", "error"],
                )

    schema = "id long, times long, data binary, list int, probes array<int>, codes binary, error double"
    return distinct.select("id", "times", "data").mapInArrow(run, schema)


def candidates(model: Quantiser, centre: np.ndarray, queries: np.ndarray, codes: np.ndarray, errors: np.ndarray, radius: float):
    """Pairs (query, member) of a list that table-lookup distances cannot rule out."""
    residuals = queries - centre
    squares = np.zeros((len(queries), len(codes)), np.float32)
    for place, ((a, b), book) in enumerate(zip(model.cuts, model.books, strict=True)):
        table = np.maximum(_squares(residuals[:, a:b], book), 0).astype(np.float32)
        squares += table[:, codes[:, place]]
    return np.nonzero(np.sqrt(squares) - errors.astype(np.float32)[None, :] <= radius + 1e-3)


def block_links(model: Quantiser, place: int, members: dict, queries: dict, threshold: float):
    """Links between a block of a list's members and a block of its queries: ids, links of each (copies
    counted), and a root each is joined to by links of this block.

    A pair is met from both sides if both vectors probe each other's list, and then each side counts its own;
    otherwise the side that meets it counts for both."""
    radius = float(np.sqrt(2 - 2 * threshold))
    rows, columns = candidates(
        model, model.centres[place], queries["unit"], members["codes"], members["error"], radius
    )
    kept = []
    for at in range(0, len(rows), _PAIRS):
        one, two = rows[at : at + _PAIRS], columns[at : at + _PAIRS]
        cosines = np.einsum("ij,ij->i", queries["unit"][one], members["unit"][two])
        hit = (cosines >= threshold) & (queries["id"][one] != members["id"][two])
        kept.append((one[hit], two[hit]))
    one = np.concatenate([x for x, _ in kept]) if kept else np.zeros(0, np.int64)
    two = np.concatenate([x for _, x in kept]) if kept else np.zeros(0, np.int64)
    back = members["probed"][two, queries["list"][one]]
    ids, spots = np.unique(np.concatenate([queries["id"][one], members["id"][two]]), return_inverse=True)
    left, right = spots[: len(one)], spots[len(one) :]
    links = np.bincount(left, members["times"][two], len(ids))
    links += np.bincount(right, np.where(back, 0, queries["times"][one]), len(ids))
    roots = np.arange(len(ids))
    while len(one):
        before = roots.copy()
        low = np.minimum(roots[left], roots[right])
        np.minimum.at(roots, left, low)
        np.minimum.at(roots, right, low)
        roots = roots[roots]
        if (roots == before).all():
            break
    return ids, links.astype(np.int64), ids[roots]


def _links(indexed: DataFrame, model, size: int, threshold: float) -> DataFrame:
    """``id, links, root`` from all pairs of blocks."""
    held = {row["list"]: row["count"] for row in indexed.groupBy("list").count().collect()}  # a row per list
    asked = indexed.select(F.explode("probes").alias("list")).groupBy("list").count().collect()
    sizes = [
        (row["list"], -(-held[row["list"]] // MEMBERS), -(-row["count"] // QUERIES))
        for row in asked
        if row["list"] in held
    ]
    blocks = F.broadcast(indexed.sparkSession.createDataFrame(sizes, "list int, member_blocks int, query_blocks int"))
    spread = F.xxhash64("id")
    members = indexed.join(blocks, "list").select(
        "list",
        F.pmod(spread, "member_blocks").cast("int").alias("i"),
        F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("j"),
        F.lit(True).alias("member"),
        F.col("list").alias("own"),
        "id", "times", "data", "probes", "codes", "error",
    )
    queries = (
        indexed.withColumnRenamed("list", "own")
        .withColumn("list", F.explode("probes"))
        .join(blocks, "list")
        .select(
            "list",
            F.explode(F.expr("sequence(0, member_blocks - 1)")).alias("i"),
            F.pmod(spread, "query_blocks").cast("int").alias("j"),
            F.lit(False).alias("member"),
            "own", "id", "times", "data",
            F.lit(None).cast("array<int>").alias("probes"),
            F.lit(None).cast("binary").alias("codes"),
            F.lit(None).cast("double").alias("error"),
        )
    )

    def run(key, table):
        place, found = key[0].as_py(), {}
        for member in (True, False):
            rows = table.filter(pa.compute.equal(table["member"], member))
            found[member] = {
                "id": rows["id"].to_numpy(),
                "times": rows["times"].to_numpy(),
                "list": rows["own"].to_numpy(),
                "unit": _unit(rows["data"].to_pylist(), size) if len(rows) else np.zeros((0, size)),
            }
            if member:
                codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8)
                probed = np.zeros((len(rows), len(model.value.centres)), bool)
                for at, probes in enumerate(rows["probes"].to_pylist()):
                    probed[at, probes] = True
                found[member] |= {
                    "codes": codes.reshape(len(rows), -1) if len(rows) else np.zeros((0, len(model.value.cuts)), np.uint8),
                    "error": rows["error"].to_numpy(),
                    "probed": probed,
                }
        ids, links, roots = block_links(model.value, place, found[True], found[False], threshold)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links), "root": pa.array(roots, pa.int64())})

    return members.unionByName(queries).groupBy("list", "i", "j").applyInArrow(run, "id long, links long, root long")


def near_vectors(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    reach: float = REACH,
) -> DataFrame:
    """The id column, ``n_links`` (other rows linked directly) and ``component_id`` (smallest id reachable)."""
    spark = df.sparkSession
    rows = settled(
        _rows(df, id_column, vector_column).withColumn("key", F.when(F.col("id").isNotNull(), F.sha2("data", 256)))
    )
    usable = rows.filter(F.col("key").isNotNull())
    distinct = settled(
        usable.groupBy("key").agg(
            F.min("id").alias("id"), F.count("*").alias("times"), F.first("size").alias("size"), F.first("data").alias("data")
        )
    )
    total = distinct.agg(F.sum("times")).first()[0] or 0
    found = None
    for size, count in sorted(tuple(row) for row in distinct.groupBy("size").count().collect()):  # a row per length
        own = distinct.filter(F.col("size") == size)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("data").toArrow()["data"].to_pylist()
        lists = min(max(1, round(count**0.5)), MAX_LISTS, max(1, len(sample) // 8))
        model = spark.sparkContext.broadcast(fit(_unit(sample, size), lists))
        indexed = settled(_indexed(own, model, size, reach * float(np.sqrt(2 - 2 * threshold)) / 2))
        links = _links(indexed, model, size, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    found = settled(found)
    roots = components(found.filter("id <> root"), "id", "root").select(F.col("node").alias("id"), "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        distinct.select("key", "id", "times")
        .join(counts, "id", "left")
        .join(roots.distinct(), "id", "left")
        .select(
            "key",
            "times",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        )
    )
    linked = join_spread(usable.select("id", "key"), named, "key", "times", total).select("id", "n_links", "component_id")
    alone = rows.filter(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_column)
