"""Op 13. Clustering around centroids with a LAESA pivot table.

The pivots are a few of the starting centroids that lie far from each other, and stay as they are. How far
every vector is from each pivot is written once, beside the vector. In each round the centroids' own
distances to the pivots are made anew, and the largest difference of the two bounds from below how far a
centroid can be from a vector. The centroid of the least bound is measured first; those whose bound isn't
above that distance survive and get exact integer distances. Tasks add up their vectors by cluster, so a
round sends one row for each task, centroid and component, and the driver holds the centroids alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, work_dir

CENTROIDS = 40
DIM = 64
ROUNDS = 5
SCALE = 256
PIVOTS = 8
#: Rows that a worker measures at once.
ROWS = 4096
#: Components below this in size have squared distances that 64 bits hold.
SMALL = 1 << 27
MOST = (1 << 63) - 1


def _sql() -> str:
    distance = "CAST(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT)"
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40
)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT v.rid, c.c, {distance} AS d FROM v CROSS JOIN c{k} c)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM d{k} GROUP BY rid)")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS v FROM (SELECT a.c, i, floor(sum(v.v[i]) / count(*)) AS m FROM a{k} a JOIN v USING (rid) CROSS JOIN range(1, 65) r(i) GROUP BY a.c, i) GROUP BY c
  UNION ALL SELECT c, v FROM c{k} WHERE c NOT IN (SELECT c FROM a{k})
)""")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN c{ROUNDS} c ON c.c = a.c"""


SQL = _sql()


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v (integers floor(scale * x)) of the vectors of ``dim`` components, none null or non-finite.

    Rows that repeat stay as often as they come, and so do rows without an id.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where((F.size("embedding") == dim) & usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def whole(rows, dim: int):
    """``rows`` as a matrix: 64-bit integers where distances fit in them, else Python's own."""
    import numpy as np

    m = np.array([list(r) for r in rows], dtype="int64").reshape(len(rows), dim)
    return m if not m.size or max(int(m.max()), -int(m.min())) < SMALL else m.astype(object)


def alike(x, y):
    """Both in the wider of their types."""
    return (x.astype(object), y.astype(object)) if object in (x.dtype, y.dtype) else (x, y)


def squared(x, y):
    """Exact squared distances of rows of ``x`` from the row ``y``, or from as many rows."""
    import numpy as np

    x, y = alike(x, y)
    diff = x - y
    return (diff * diff).sum(axis=1) if diff.dtype == object else np.einsum("ij,ij->i", diff, diff)


def far_apart(points: list, most: int) -> list[int]:
    """Which of ``points`` serve as pivots: the first, then always the one whose distances to those taken add up to most."""
    import numpy as np

    if not points:
        return []
    m, chosen = whole(points, len(points[0])), [0]
    total = np.sqrt(squared(m, m[0]).astype("float64"))
    while len(chosen) < min(most, len(points)):
        rest = [k for k in range(len(points)) if k not in chosen]
        chosen.append(max(rest, key=lambda k: (total[k], -k)))
        total = total + np.sqrt(squared(m, m[chosen[-1]]).astype("float64"))
    return chosen


def pivot_distances(m, pivots):
    """Distances of every row to every pivot, as doubles."""
    import numpy as np

    return np.stack([np.sqrt(squared(m, p).astype("float64")) for p in pivots], axis=1)


def nearest(m, table, centroids, of_centroids):
    """The nearest centroid of every row and its exact squared distance; ties go to the smaller number.

    ``table`` and ``of_centroids`` have the distances of both to the pivots. These are doubles, so bounds are
    taken a little lower, and what they might wrongly exclude is measured.
    """
    import numpy as np

    bound = np.zeros((len(m), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - of_centroids[None, :, p]), out=bound)
    bound -= 1e-9 * (table.max(axis=1, initial=0)[:, None] + of_centroids.max(axis=1, initial=0)[None, :])
    first = squared(m, centroids[bound.argmin(axis=1)])
    survives = bound <= np.sqrt(first.astype("float64"))[:, None] * (1 + 1e-12)
    at, best = np.full(len(m), -1), first.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero(survives[:, c])
        d = squared(m[rows], centroids[c])
        better = (d < best[rows]) | (d == best[rows]) & (at[rows] < 0)
        at[rows[better]], best[rows[better]] = c, d[better]
    return at, best


def _parts(batches, dim: int) -> Iterator[tuple]:
    """(ids, matrix, pivot table) of at most ROWS rows at once."""
    import numpy as np

    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            v = part.column("v")
            flat = np.asarray(v.flatten()).reshape(part.num_rows, dim)
            m = flat if max(int(flat.max()), -int(flat.min())) < SMALL else flat.astype(object)
            table = np.asarray(part.column("p").flatten()).reshape(part.num_rows, -1) if "p" in part.schema.names else None
            yield part.column("vec_id"), m, table


def with_pivots(rows: DataFrame, pivots: list, dim: int, path: str) -> DataFrame:
    """``rows`` with their distances to the pivots ``p``, written once."""
    points = whole(pivots, dim)

    def measure(batches):
        import pyarrow as pa

        for ids, m, _ in _parts(batches, dim):
            flat = pa.array(pivot_distances(m, points).ravel())
            own = pa.ListArray.from_arrays(range(0, len(m) * len(points) + 1, len(points)), flat)
            vectors = pa.ListArray.from_arrays(range(0, len(m) * dim + 1, dim), pa.array(m.astype("int64").ravel()))
            yield pa.RecordBatch.from_arrays([ids, vectors, own], ["vec_id", "v", "p"])

    return staged(rows.mapInArrow(measure, "vec_id long, v array<long>, p array<double>"), path)


def moved(table: DataFrame, centroids: list[list[int]], pivots: list, dim: int) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of their vectors; empty ones stay."""
    c, points = whole(centroids, dim), whole(pivots, dim)
    near = pivot_distances(c, points)

    def sums(batches):
        import decimal

        import numpy as np
        import pyarrow as pa

        n, total = {}, {}
        for _, m, p in _parts(batches, dim):
            at, _ = nearest(m, p, c, near)
            for k in np.unique(at).tolist():
                own = m[at == k]
                n[k] = n.get(k, 0) + len(own)
                total[k] = total.get(k, 0) + own.sum(axis=0).astype(object)
        rows = [(k, i, n[k], decimal.Decimal(int(x))) for k, t in total.items() for i, x in enumerate(t)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["cluster", "i", "n", "total"])

    found = table.mapInArrow(sums, "cluster int, i int, n long, total decimal(38,0)")
    out = [list(x) for x in centroids]
    for r in found.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # centroids x components
        out[r["cluster"]][r["i"]] = int(r["total"]) // r["n"]
    return out


def assigned(table: DataFrame, centroids: list[list[int]], pivots: list, dim: int) -> DataFrame:
    """vec_id, cluster and distance of every row."""
    c, points = whole(centroids, dim), whole(pivots, dim)
    near = pivot_distances(c, points)

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for ids, m, p in _parts(batches, dim):
            at, d = nearest(m, p, c, near)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype("int32")), pa.array(np.minimum(d, MOST).astype("int64"))], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``vectors``.

    Rows without an id are kept but never start a centroid; with fewer than ``k`` rows there are fewer
    centroids, and equal ones leave all but the first empty. Distances beyond 64 bits are compared exactly
    and given as the largest long, and so are their sums. Columns other than vec_id and embedding are ignored.
    """
    import hashlib

    spark, path = vectors.sparkSession, work_dir(vectors.sparkSession)
    rows = staged(kept(vectors, dim, scale), f"{path}/kept")
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in rows.where("vec_id is not null").orderBy(key, "v").limit(k).collect()]
    if not centroids:  # no centroid, no cluster
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    fixed = [centroids[i] for i in far_apart(centroids, pivots)]
    table = with_pivots(rows, fixed, dim, f"{path}/pivots")
    for _ in range(rounds):
        before, centroids = centroids, moved(table, centroids, fixed, dim)
        if centroids == before:  # nothing would change any more
            break
    found = staged(assigned(table, centroids, fixed, dim), f"{path}/assigned")
    for name in ("kept", "pivots"):
        discard(spark, f"{path}/{name}")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    total = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(total.alias("cluster_inertia"))
    every = found.agg(total.alias("inertia"))
    told = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sums, "cluster").join(F.broadcast(every))
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings around 40 centroids."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
