import math
import random

from convlake.llm.topk import SQL, op7_top_k, quantised, top_k

from .data import SF


def plain(rows, asked, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted({(i, tuple(v)) for i, v in ok})
    out = set()
    for i in {i for i, _ in ok if i in asked}:
        v = min(v for j, v in ok if j == i)
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_awkward(spark, monkeypatch):
    r = random.Random(2)
    near = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.1 if i % 3 else 1) for x in near]) for i in range(300)]
    rows = [(i, [float(f"{x:.3f}") * (1 + i % 7) for x in v]) for i, v in rows]
    rows += [(None, near), (400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, []), (500, [0.0] * 8), (520, [1.0, 2.0]), (7, rows[7][1]), (7, rows[7][1]), (20, rows[40][1])]
    rows += [(600 + i, rows[60][1]) for i in range(40)]
    from convlake.llm import topk

    rows = [(i, None if v is None else [None if x is None else struct32(x) for x in v]) for i, v in rows]
    for block, group in ((4096, 512), (32, 4)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", group)
        table = vectors(spark, rows).selectExpr("*", "'x' AS score", "'x' AS block")
        got = {tuple(x) for x in top_k(table, table.where("vec_id % 20 = 0"), 5).collect()}
        assert got == plain(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 5)


def struct32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_few_and_empty(spark):
    assert top_k(vectors(spark, []), vectors(spark, [])).count() == 0
    two = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert [tuple(r) for r in top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 8192)]
    assert quantised(two).count() == 2


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert {tuple(r) for r in op7_top_k(spark, SF).collect()} == set(con.sql(SQL).fetchall())


def test_spiky_and_short(spark, monkeypatch):
    """Vectors along one axis, and of one and two dimensions, over several blocks and buckets."""
    from convlake.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = random.Random(4)
    for dim in (1, 2, 12):
        rows = []
        for i in range(200):
            v = [r.gauss(0, 0.3) for _ in range(dim)]
            if i % 2:
                v[r.randrange(dim)] = r.choice((-1, 1)) * r.uniform(2, 9)
            if i % 5 == 0:
                v = [0.9 * (1 + i % 3)] + [0.436 * (1 + i % 3)] * (dim > 1) + [0.0] * (dim - 2)
            rows.append((i, [struct32(x) for x in v]))
        table = vectors(spark, rows)
        got = {tuple(x) for x in top_k(table, table.where("vec_id % 4 = 0"), 3).collect()}
        assert got == plain(rows, set(range(0, 200, 4)), 3)
