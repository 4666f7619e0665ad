"""Centroid clustering of whole-number vectors with Elkan's bounds.

Every vector keeps an upper bound of its distance to its own centroid and a lower bound of that to
each centroid.  When centroids move, the bounds move by as much; a centroid is compared with a
vector only if neither its lower bound nor half its distance from the vector's own centroid shows
that it is further away.  Bounds are floating-point numbers that are always rounded to the safe
side, and only strictly larger ones exclude a centroid, so ties are always compared.  Comparisons
and final distances are sums of squares of whole numbers in 64 bits.

Each round writes vectors and bounds as a table in the shared folder and adds up the vectors that
have changed their cluster: the sums of the clusters follow from these.  Only centroids and sums
(clusters times components, whatever the input) pass through the driver; no shuffle moves a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterlake.llm.common import discard, materialise

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1_024, 8, 10, "3"
#: Whole numbers of this size and more would not leave room for 64 bits in a squared distance.
TOO_LARGE = 2**27
#: More than a few roundings of a double, relatively.
SLACK = 2.0**-48


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK), 0.0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` from those of ``b`` (or from the one ``b``), exactly."""
    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


class Centroids:
    """Centroids, how far each has moved, and their distances from each other, on the safe sides."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None):
        self.now = np.array(now, np.int64)
        self.moved = None if before is None else up(np.sqrt(squares(self.now, np.array(before, np.int64)).astype(float)))
        apart = squares(self.now[:, None], self.now[None])
        self.half = down(np.sqrt(apart.astype(float))) / 2
        others = self.half + np.where(np.eye(len(now), dtype=bool), np.inf, 0.0)
        self.nearest = others.min(axis=1)

    def assigned(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster and bounds of vectors up to date, in place; returns how many distances that took."""
        if self.moved is not None:
            upper[:] = up(upper + self.moved[own])
            lower[:] = down(lower - self.moved)
        doubt = np.flatnonzero(~(upper < self.nearest[own]))
        asked = len(doubt)
        best = squares(v[doubt], self.now[own[doubt]])
        upper[doubt] = up(np.sqrt(best.astype(float)))
        lower[doubt, own[doubt]] = down(np.sqrt(best.astype(float)))
        for j in range(len(self.now)):
            mine = own[doubt]
            near = np.flatnonzero((mine != j) & ~(lower[doubt, j] > upper[doubt]) & ~(self.half[mine, j] > upper[doubt]))
            rows = doubt[near]
            found = squares(v[rows], self.now[j])
            asked += len(rows)
            lower[rows, j] = down(np.sqrt(found.astype(float)))
            # the smaller number wins a tie
            won = (found < best[near]) | ((found == best[near]) & (j < own[rows]))
            own[rows[won]] = j
            upper[rows[won]] = up(np.sqrt(found[won].astype(float)))
            best[near[won]] = found[won]
        return asked


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _round(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    """id, v, cluster, before, upper, lower: one step; a null cluster has no bounds yet."""
    k, width = centroids.now.shape
    for batch in batches:
        v = _matrix(batch.column("v"), np.int64, width)
        if centroids.moved is None:
            before = np.full(len(v), -1)
            own, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), k))
        else:
            before = batch.column("cluster").to_numpy().astype(np.int64)
            own, upper, lower = before.copy(), batch.column("upper").to_numpy().copy(), _matrix(batch.column("lower"), float, k)
        centroids.assigned(v, own, upper, lower)
        columns = {"cluster": pa.array(own.astype(np.int32)), "before": pa.array(before.astype(np.int32)), "upper": pa.array(upper), "lower": _lists(lower)}
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *columns.values()], names=["id", "v", *columns])


def _changes(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """cluster, at (component, or -1 for the count) and total: what moved vectors add to and take from clusters."""
    total = np.zeros((k, width + 1), np.int64)
    rows = 0

    def told() -> pa.RecordBatch:
        own, at = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total[own, at])], names=["cluster", "at", "total"])

    for batch in batches:
        v = _matrix(batch.column("v"), np.int64, width)
        v = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
        for name, sign in (("cluster", 1), ("before", -1)):
            own = batch.column(name).to_numpy()
            np.add.at(total, own[own >= 0], sign * v[own >= 0])
        rows += len(v)
        # 2 ** 27 times these rows stays far within 64 bits
        if rows > 2**30:
            yield told()
            total[:], rows = 0, 0
    yield told()


def _distances(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("cluster")
        d = squares(_matrix(batch.column("v"), np.int64, centroids.now.shape[1]), centroids.now[own.to_numpy()])
        yield pa.RecordBatch.from_arrays([batch.column("id"), own, pa.array(d)], names=["id", "cluster", "distance"])


def prepared(vectors: DataFrame, vec_id: str, vector: str, components: int, scale: int) -> DataFrame:
    """id and ``v`` (whole numbers) of the vectors that are kept."""
    x = F.col(vector)
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    kept = vectors.where(F.coalesce((F.size(x) == components) & ~F.exists(x, odd), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.abs(c.cast("double") * scale), F.lit(float(TOO_LARGE))) * F.signum(c.cast("double"))).cast("int"))
    v = F.when(F.exists("v", lambda c: F.abs(c) >= TOO_LARGE), F.raise_error(F.lit(f"a component of {TOO_LARGE // scale} or more: squared distances would pass 64 bits"))).otherwise(F.col("v"))
    return kept.select(F.col(vec_id).alias("id"), scaled.alias("v")).select("id", v.alias("v"))


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The id, ``cluster`` and squared ``distance`` of every kept vector, with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors with another number of components, or with null or non-finite ones, are left out, as
    are null vectors; components are scaled and floored to whole numbers.  The first centroids are
    the vectors whose ``seed:id`` has the smallest SHA-256 (a null id counts as an empty text; of
    equal ids the smaller vector comes first); fewer vectors make fewer centroids.  Repeated rows
    count each time and each gets its row.  Distances that tie go to the smaller number; a cluster
    without vectors keeps its centroid.  Columns besides id and vector are not read.  Components so
    large that a squared distance would not fit 64 bits are refused.  An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    start = prepared(vectors, vec_id, vector, components, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    now = [list(r[0]) for r in start.select("v", key.alias("h")).orderBy("h", "v").limit(clusters).select("v").collect()]
    kind = vectors.schema[vec_id].dataType
    out = T.StructType([T.StructField(vec_id, kind), *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
    if not now:
        return spark.createDataFrame([], out)
    k = len(now)
    state = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.IntegerType())), *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("before", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.ArrayType(T.DoubleType()))))])
    table, before, sums = start, None, [[0] * (components + 1) for _ in range(k)]
    for nth in range(rounds + 1):
        centroids = Centroids(now, before)
        last, table = table, materialise(table.mapInArrow(lambda batches, c=centroids: _round(batches, c), state), "centroids")
        discard(last)
        if nth == rounds:
            break
        changes = table.where("cluster <> before").select("v", "cluster", "before").mapInArrow(lambda batches: _changes(batches, k, components), "cluster int, at int, total long")
        # clusters times components rows
        for r in changes.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            sums[r["cluster"]][r["at"] + 1] += int(r["total"])
        before, now = now, [[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(sums, now)]
    found = table.select("id", "v", "cluster").mapInArrow(lambda batches: _distances(batches, centroids), T.StructType([state["id"], state["cluster"], T.StructField("distance", T.LongType())]))
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]

    def of_cluster(values: list) -> F.Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cluster"))

    return found.select(
        F.col("id").alias(vec_id),
        "cluster",
        "distance",
        of_cluster([inertia.get(c, 0) for c in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
