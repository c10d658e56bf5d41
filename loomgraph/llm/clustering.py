"""Centroid clustering by exponion search, in exact integers.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to any other. Where they
don't settle its cluster, only centroids inside a ball around its current one are compared: a centroid nearer than, or
as near as, the current one lies within twice the vector's distance plus the distance to the next centroid. Centroids
are listed by their distance from each other, so a ball is a prefix of a list; its radius is inclusive, which keeps
ties. Distances are compared as integers; bounds are rounded outwards, so they never decide what is close to a tie.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, tidy, written

DIMENSION, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Scaled components beyond this would make squared distances that 64 bits can't hold.
MOST_COMPONENT = 1 << 27
#: Vectors that a task works on at once.
BLOCK = 4096
#: Bounds are widened by this share at each step, far more than floating-point arithmetic can be wrong by.
SLACK = 1e-9

STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double, distance long"


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to rows of c."""
    out = np.empty((len(v), len(c)), np.int64)
    for k, row in enumerate(c):
        d = v - row
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


class Exponion:
    """What a round knows of its centroids."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        self.moved = np.zeros(k) if moved is None else moved
        between = np.sqrt(_squared(centroids, centroids).astype(np.float64))
        far = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.next = far.min(1) if k > 1 else np.full(k, np.inf)
        # Each centroid's list begins with itself; of equal distances the order doesn't matter.
        self.order = np.argsort(np.where(np.eye(k, dtype=bool), -1.0, between), axis=1, kind="stable")
        self.away = np.take_along_axis(between, self.order, 1)
        self.others_moved = np.array([max([m for j, m in enumerate(self.moved) if j != a], default=0.0) for a in range(k)])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, compared): nearest centroids, ties to the smaller number, and how many distances were
        taken. cluster: of the round before; -1: none yet, so all centroids are compared."""
        cluster, compared = cluster.copy(), 0
        new = cluster < 0
        at = np.where(new, 0, cluster)
        upper = np.where(new, np.inf, (upper + self.moved[at]) * (1 + SLACK))
        lower = np.where(new, 0.0, np.maximum(lower - self.others_moved[at], 0.0) * (1 - SLACK))
        bound = np.maximum(lower, self.next[at] / 2 * (1 - SLACK))
        unsettled = np.flatnonzero(new | (upper >= bound))
        if len(unsettled):  # the exact distance may settle it
            old = unsettled[~new[unsettled]]
            d = v[old] - self.c[cluster[old]]
            upper[old] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + SLACK)
            compared += len(old)
            unsettled = unsettled[new[unsettled] | (upper[unsettled] >= bound[unsettled])]
        for a in np.unique(at[unsettled]):
            mine = unsettled[at[unsettled] == a]
            radius = (2 * upper[mine] + self.next[a]) * (1 + SLACK)
            reach = np.where(np.isfinite(radius), np.searchsorted(self.away[a], radius, side="right"), len(self.c))
            ring = np.where(reach > 1, 1 << np.ceil(np.log2(np.maximum(reach, 1))).astype(np.int64), 1)
            for r in np.unique(ring):  # vectors with balls of about the same size go together
                rows = mine[ring == r]
                inside = np.sort(self.order[a][: min(int(r), len(self.c))])
                d = _squared(v[rows], self.c[inside])
                compared += d.size
                best = d.argmin(1)  # the first of equals is the smaller number
                cluster[rows] = inside[best]
                upper[rows] = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64)) * (1 + SLACK)
                d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
                second = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if len(inside) > 1 else np.full(len(rows), np.inf)
                # What lies outside the ball is farther away than the second nearest, if the ball has two.
                lower[rows] = second if len(inside) > 1 or len(self.c) == 1 else 0.0
        return cluster, upper, lower, compared


def _rows_of(batch) -> np.ndarray:
    n = batch.num_rows
    v = batch["v"]
    return np.frombuffer(b"".join(v.to_pylist()), "<i4").reshape(n, -1).astype(np.int64) if n else np.zeros((0, 1), np.int64)


def _assigned(centroids: np.ndarray, moved: np.ndarray | None):
    def run(batches):
        import pyarrow as pa

        known = Exponion(centroids, moved)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v, was = _rows_of(batch), batch["cluster"].to_numpy(zero_copy_only=False)
                cluster, upper, lower, _ = known.assign(v, was, batch["upper"].to_numpy(zero_copy_only=False), batch["lower"].to_numpy(zero_copy_only=False))
                d = v - centroids[cluster]
                cols = [batch["vec_id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(np.einsum("ij,ij->i", d, d))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cluster", "was", "upper", "lower", "distance"])

    return run


def _changes(k: int, dimension: int):
    """Of each task: what clusters gain and lose, as a row for each cluster."""

    def run(batches):
        import pyarrow as pa

        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _rows_of(batch)
            for name, sign in (("cluster", 1), ("was", -1)):
                c = batch[name].to_numpy(zero_copy_only=False)
                known = c >= 0
                np.add.at(sums, c[known], sign * v[known])
                counts += sign * np.bincount(c[known], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def quantised(table: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, v): of vectors that take part, floor(scale * x) of their components x as 32-bit little-endian integers."""
    x = F.transform(F.col(column), lambda y: y.cast("double"))
    q = F.transform(x, lambda y: F.lit(float(scale)) * y)
    fine = F.forall(q, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < MOST_COMPONENT))
    rows = table.filter((F.size(column) == dimension) & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(q, lambda y: F.floor(y).cast("int")).alias("q"))

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            v = b["q"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(b.num_rows, dimension)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(packed, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """Those with the least hashes of seed and id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64)


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = 2, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids): after `rounds` rounds of assigning and averaging and one more of assigning.

    Vectors that are null, of another length, or hold null, not-a-number or infinite components take no part, nor do
    those with a scaled component of 2 ** 27 or more, whose squared distances 64 bits can't hold. Ids may be null (hashed
    as an empty id) or repeat: each row is a vector of its own; centroids of equal hash come in order of their bytes.
    With fewer vectors than k there are fewer centroids; equal vectors may make equal centroids, of which the smaller
    number gets all. An empty table gives no rows and no centroids. Other columns aren't read.

    A round reads the state of the one before and writes its own, which replaces it, in the shared folder; nothing is
    shuffled but a row of sums for each task and cluster, of the vectors that changed cluster. Centroids (k rows) are
    known to all.
    """
    none = [F.lit(-1).cast("int").alias("cluster"), F.lit(-1).cast("int").alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance")]
    state, place = written(quantised(table, dimension, scale, column).select("vec_id", "v", *none), "cluster-vectors")
    centroids, moved = first_centroids(state, k, seed), None
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance"), centroids
    k = len(centroids)
    sums, counts = np.zeros((k, dimension), object), np.zeros(k, object)
    for step in range(rounds + 1):
        last = place
        state, place = written(state.mapInArrow(tidy(_assigned(centroids, moved)), STATE), f"cluster-{step}")
        delete(table.sparkSession, last)
        if step == rounds:
            break
        changes = state.filter("cluster != was").select("v", "cluster", "was").mapInArrow(tidy(_changes(k, dimension)), "cluster int, n long, sums array<long>")
        total = changes.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimension)])
        for r in total.collect():  # k rows
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] += np.array(r[2:], object)
        new = np.array([[int(x) // int(n) for x in s] if n else c.tolist() for s, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centroids = new
    return state.select("vec_id", "cluster", "distance"), centroids


def query(spark, sf_dir: str) -> DataFrame:
    """All of embeddings."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(each.crossJoin(F.broadcast(whole))), "cluster").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql() -> str:
    """Every distance in every round, over the same integers."""
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs({SCALE} * CAST(x AS DOUBLE)) < {MOST_COMPONENT})) = {DIMENSION})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS k, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {CENTROIDS}) x)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT nth, vec_id, q, d.k AS k, d.d AS d FROM (SELECT v.nth, v.vec_id, v.q, min(struct_pack(d := CAST({near} AS BIGINT), k := c.k)) AS d FROM v, c{r} c GROUP BY ALL) x)")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT k, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS q FROM (
  SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM (SELECT k, unnest(q) AS x, unnest(range({DIMENSION})) AS i FROM a{r}) y GROUP BY k, i) z GROUP BY k) m ON c.k = m.k)""")
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM {last} a JOIN c{ROUNDS} c ON a.k = c.k"""
    )


SQL = _sql()
