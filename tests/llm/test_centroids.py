import hashlib
import math
import random

import duckdb

from convlake.llm.centroids import SQL, clustered, op13_centroid_clusters

from .data import SF


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    at = [(i, *reversed(near(v))) for i, v in kept]
    most = (1 << 63) - 1
    cost = {n: sum(min(d, most) for _, m, d in at if m == n) for n in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i or -1, n, min(d, most), min(cost[n], most), min(sum(cost.values()), most), sha[n]) for i, n, d in at)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "'x' AS v", "'x' AS p")


def told(df):
    return sorted((r[0] or -1, *r[1:]) for r in df.collect())


def test_awkward(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 4, 0.4) for _ in range(6)]) for i in range(200)]
    rows += [(300, None), (301, [1.0] * 5), (302, [None] * 6), (303, [math.inf] * 6), (304, [math.nan] * 6), (None, [0.5] * 6), (7, rows[7][1]), (7, rows[9][1])]
    for k, rounds in ((7, 4), (1, 2), (40, 0)):
        assert told(clustered(vectors(spark, rows), k, rounds, 6, pivots=3)) == plain(rows, k, rounds, 6)


def test_ties_empty_centroids_and_few_rows(spark):
    same = [(i, [1.0, 2.0]) for i in range(9)] + [(9, [5.0, 5.0])]
    assert told(clustered(vectors(spark, same), 4, 3, 2)) == plain(same, 4, 3, 2)
    square = [(i, [float(i % 2), float(i // 2 % 2)]) for i in range(8)]
    assert told(clustered(vectors(spark, square), 3, 2, 2)) == plain(square, 3, 2, 2)
    assert clustered(vectors(spark, []), 4, 3, 2).count() == 0
    one = [(5, [0.25, -0.25])]
    assert told(clustered(vectors(spark, one), 4, 3, 2)) == plain(one, 4, 3, 2)


def test_large_components_are_exact(spark):
    rows = [(i, [float(10 ** (i % 9)) + i, -float(i) * 3e6]) for i in range(30)]
    assert told(clustered(vectors(spark, rows), 5, 3, 2)) == plain(rows, 5, 3, 2)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, op13_centroid_clusters(spark, SF).collect())) == sorted(con.sql(SQL).fetchall())
