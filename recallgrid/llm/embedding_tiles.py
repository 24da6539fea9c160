"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are brought to length 1 and rotated to the principal axes of all of them, which leaves every
dot product as it is but puts most of it into the leading dimensions. They are cut along the AXES strongest axes, one after
another, into tiles of about TILE vectors. Two unit vectors of cosine c are sqrt(2 - 2c) apart, and at least as far as their leading
coordinates and the norms of the rest are, so tiles whose boxes are further apart than the threshold
allows never meet, and nothing is sent for them. Where two tiles meet, dot products are accumulated over the leading dimensions
first; by Cauchy-Schwarz the rest is at most the product of the norms of the remaining dimensions, and pairs that
can no longer reach the threshold are dropped before the next dimensions are added.

The result is exact: all pairs whose cosine reaches the threshold, those that equal it too. Every vector is compared as a query.
``classes`` has a row for every vec_id with its class, the least vec_id that pairs lead to. Where two tiles meet, no more is sent on than one row for each
vector that has a partner there, so the rows grow as the vectors do. ``pairs`` has a row for every pair.

Defined results: a null, empty or zero vector, one with a null or a value that is not finite, and a null
vec_id have no partner; in ``classes`` each vec_id that is not null has a row. Vectors of different widths are no pair; every width has axes and tiles of its own. A pair of rows with the same vec_id is no pair; a vec_id of
several vectors is of the class of each. Repeated rows count once; an empty table has no rows. Vectors are compared whole, of any width. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches
from .ngram_join import components

THRESHOLD = 0.95
TILE = 4096
#: Leading axes that tiles are cut along.
AXES = 3
#: Dimensions after which candidates are thinned out, as shares of the width.
STEPS = (0.125, 0.25, 0.5, 1.0)
SLACK = 1e-9
SCHEMA = "vec_id_a long, vec_id_b long, cosine double"
EDGES = "a long, b long"
#: Rows of one tile that are compared with the other tile at once.
STRIP = 512


def _vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of usable vectors of all widths."""
    kept = embeddings.schema["embedding"].dataType.simpleString()
    # single precision is sent as it is stored, which halves what is shuffled
    v = F.col("embedding").cast(kept if kept in ("array<float>", "array<double>") else "array<double>")
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return usable.where("forall(v, x -> x IS NOT NULL AND x = x AND abs(x) < double('infinity')) AND exists(v, x -> x != 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return _unit(m)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def axes(vectors: DataFrame) -> np.ndarray:
    """Principal axes of all unit vectors as columns, the strongest first; one small matrix a task comes to the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in rows:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                total = total + m.T @ m
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    summed = vectors.select("v").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    width = math.isqrt(len(summed))
    values, found = np.linalg.eigh(summed["x"].to_numpy().reshape(width, width))
    return found[:, ::-1]


def compare(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and cosines of all pairs at or above the threshold; rows are rotated unit vectors."""
    width = a.shape[1]
    cuts = sorted({max(1, math.ceil(s * width)) for s in STEPS})
    left, right, cosine = [], [], []
    rest_b = [np.linalg.norm(b[:, k:], axis=1) for k in cuts]
    for at in range(0, len(a), STRIP):
        x = a[at : at + STRIP]
        dot = x[:, : cuts[0]] @ b[:, : cuts[0]].T
        rest = np.linalg.norm(x[:, cuts[0] :], axis=1)
        i, j = np.nonzero(dot + np.outer(rest, rest_b[0]) >= threshold - SLACK)
        value = dot[i, j]
        for step, (low, high) in enumerate(zip(cuts, cuts[1:]), 1):
            rest = np.linalg.norm(x[:, high:], axis=1)
            parts = []
            for s in range(0, len(i), 1 << 18):  # bounds the memory of the gathered rows
                p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
                parts.append(np.einsum("ij,ij->i", x[p, low:high], b[q, low:high]))
            value = value + np.concatenate(parts) if parts else value
            keep = value + rest[i] * rest_b[step][j] >= threshold - SLACK
            i, j, value = i[keep], j[keep], value[keep]
        left.append(i + at), right.append(j), cosine.append(value)
    return np.concatenate(left), np.concatenate(right), np.concatenate(cosine)


def stars(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs that connect the same ids: each id with the least of its connected part."""
    ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    x, y = at[: len(p)], at[len(p) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        near = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(near, side, least)
        near = near[near]
        if (near == label).all():
            part = np.flatnonzero(label != np.arange(len(ids)))
            return ids[label[part]], ids[part]
        label = near


def _by_width(embeddings: DataFrame, threshold: float, tile: int, expand: bool) -> DataFrame | None:
    vectors = _vectors(embeddings)
    # a width of one vector has no pair
    widths = vectors.groupBy(F.size("v").alias("width")).count().where("count > 1").orderBy("width").collect()
    found = [_of_width(vectors.where(F.size("v") == r["width"]), threshold, tile, expand) for r in widths]
    return reduce(DataFrame.union, found) if found else None


def pairs(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine) with vec_id_a < vec_id_b of all pairs of one width at or above the threshold."""
    found = _by_width(embeddings, threshold, tile, True)
    return embeddings.sparkSession.createDataFrame([], SCHEMA) if found is None else found.distinct()


def classes(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, class_id) of every vec_id: the least one that pairs at or above the threshold lead to."""
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    found = _by_width(embeddings, threshold, tile, False)
    if found is None:
        return ids.select("vec_id", F.col("vec_id").alias("class_id"))
    # components reads the edges twice
    labels = components(batches.cut(found)).select(F.col("node").alias("vec_id"), "label")
    return ids.join(labels, "vec_id", "left").select("vec_id", F.coalesce("label", "vec_id").alias("class_id"))


def _cut(turned: DataFrame, count: int, tile: int) -> DataFrame:
    """turned with a tile number, from quantiles of one leading axis within each part that those before it made."""
    tiles, made = max(1, math.ceil(count / tile)), 1
    tiled = turned.withColumn("tile", F.lit(0))
    for axis in range(AXES):
        # as many parts as share what is left out evenly among the axes to come
        parts = math.ceil((tiles / made) ** (1 / (AXES - axis)) - 1e-9)
        if parts < 2:
            break
        steps = [k / parts for k in range(1, parts)]
        # a border may be off by a little, a tile is then larger
        rows = tiled.where(F.size("lead") > axis).groupBy("tile").agg(F.percentile_approx(F.col("lead")[axis], F.array(*map(F.lit, steps)), F.lit(1000 * parts)).alias("borders")).collect()
        borders = np.full((made, parts - 1), np.inf)
        for r in rows:
            borders[r["tile"]] = r["borders"]
        place = F.pandas_udf(lambda t, x, borders=borders, parts=parts: t * parts + (x.to_numpy()[:, None] > borders[t.to_numpy()]).sum(axis=1), "int")
        tiled = tiled.withColumn("tile", place("tile", F.coalesce(F.col("lead")[axis], F.lit(0.0))))
        # every axis has one pass over the leading coordinates to find its borders, and the numbers are kept for the next one
        tiled, made = batches.cut(tiled), made * parts
    return tiled


def _of_width(vectors: DataFrame, threshold: float, tile: int, expand: bool) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(axes(vectors))
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def rotate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                m = _matrix(batch.column("v")) @ shared.value[:, :AXES]
                rest = np.sqrt(np.maximum(0, 1 - (m * m).sum(axis=1)))
                raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(m), -1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array(rest), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "lead", "rest", "v"])

    turned = batches.cut(vectors.distinct().mapInArrow(rotate, "vec_id long, lead array<double>, rest double, v binary"))
    tiled = _cut(turned, turned.count(), tile)
    width = min(AXES, shared.value.shape[1])
    sides = [F.col("lead")[k] for k in range(width)] + [F.col("rest")]
    ranges = tiled.groupBy("tile").agg(F.array(*map(F.min, sides)).alias("low"), F.array(*map(F.max, sides)).alias("high"))
    a, b = (ranges.select(*[F.col(c).alias(f"{c}_{p}") for c in ranges.columns]) for p in "ab")
    # the distance of two boxes along one side
    gap = [F.greatest(F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k], F.lit(0.0)) for k in range(width + 1)]
    apart = reduce(lambda x, y: x + y, [g * g for g in gap])
    meet = batches.cut(a.join(b, (F.col("tile_a") <= F.col("tile_b")) & (apart <= 2 - 2 * threshold + 1e-7)).select("tile_a", "tile_b"))
    sent = tiled.join(meet.withColumn("tile", F.explode(F.array_distinct(F.array("tile_a", "tile_b")))), "tile").select("tile_a", "tile_b", "tile", "vec_id", "v")

    def run(table: pa.Table) -> pa.Table:
        one, other = table["tile_a"][0].as_py(), table["tile_b"][0].as_py()
        place = table["tile"].to_numpy()
        ids = table["vec_id"].to_numpy()
        m = _unit(np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)) @ shared.value
        x, y = place == one, place == other
        i, j, cosine = compare(m[x], m[y], threshold)
        p, q = ids[x][i], ids[y][j]
        keep = (p != q) & (cosine >= threshold) if one != other else (p < q) & (cosine >= threshold)
        p, q, cosine = p[keep], q[keep], cosine[keep]
        if not expand:
            return pa.table(dict(zip("ab", stars(p, q))))
        return pa.table({"vec_id_a": np.minimum(p, q), "vec_id_b": np.maximum(p, q), "cosine": np.round(cosine, 6)})

    return sent.groupBy("tile_a", "tile_b").applyInArrow(run, SCHEMA if expand else EDGES)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(batches.read(spark, sf_dir, "embeddings"))


PAIRS_ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
"""

ORACLE = f"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS vec_id, b AS other FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id)
SELECT i.vec_id, least(i.vec_id, coalesce(m.least, i.vec_id)) AS class_id
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) i LEFT JOIN m ON m.vec_id = i.vec_id
"""


#: The least cosine that pairs of unlike vectors reach too: it shows that nothing is lost where the production threshold finds little.
LOOSE = 0.4


def loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(batches.read(spark, sf_dir, "embeddings"), LOOSE)


LOOSE_ORACLE = PAIRS_ORACLE.replace(f">= {THRESHOLD}", f">= {LOOSE}")
