import math
import random

import duckdb
import numpy as np
import pytest

from convlake.llm import hard_negatives as H

from .data import SF


def plain(rows, every, positives=5, negatives=3):
    ok = {(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i in {i for i, _, _ in ok if i % every == 0}:
        label, v = min((own, v) for j, own, v in ok if j == i)
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, own) for j, own, w in ok if j != i)
        for s, j in [(s, j) for s, j, own in scored if own == label][:positives]:
            within = [(t, k) for t, k, own in scored if own != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out |= {(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(within)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS tile", "'x' AS score", "'x' AS slot")


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (64, 64, 64), (65, 33, 70), (3, 0, 4), (130, 9, 40)])
def test_strassen(shape):
    r = np.random.default_rng(1)
    n, k, m = shape
    for size in (200, 1 << 30, 1 << 62):
        a, b = r.integers(-size, size, (n, k)), r.integers(-size, size, (k, m))
        with np.errstate(over="ignore"):
            assert (H.strassen(a, b, leaf=4) == a @ b).all()


def test_awkward(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, r.randrange(4), [round(r.gauss(0.4, 0.6), 2) for _ in range(7)]) for i in range(260)]
    rows += [(None, 1, [1.0]), (500, None, [1.0]), (550, 1, None), (600, 1, [1.0, None]), (650, 2, [math.nan]), (700, 2, [math.inf]), (750, 3, []), (800, 3, [0.0] * 7), (850, 0, [1.0, 2.0]), (5, *rows[5][1:]), (5, *rows[5][1:]), (10, 2, rows[30][2]), (30, 9, rows[30][2])]
    rows += [(900 + i, i % 3, rows[40][2]) for i in range(30)]
    for anchors, candidates, held in ((512, 2048, 64), (4, 16, 2)):
        monkeypatch.setattr(H, "ANCHORS", anchors)
        monkeypatch.setattr(H, "CANDIDATES", candidates)
        monkeypatch.setattr(H, "HELD", held)
        got = [tuple(x) for x in H.hard_negatives(vectors(spark, rows), 10).collect()]
        assert sorted(got) == sorted(plain(rows, 10))


def test_few_and_empty(spark):
    assert H.hard_negatives(vectors(spark, [])).count() == 0
    assert H.hard_negatives(vectors(spark, [(50, 1, [1.0])])).count() == 0
    some = [(50, 1, [1.0, 1.0]), (51, 1, [2.0, 2.0]), (52, 2, [1.0, 1.0]), (53, 3, [1.9, 1.9]), (54, 2, [0.5, 0.5])]
    assert {tuple(x) for x in H.hard_negatives(vectors(spark, some)).collect()} == plain(some, 50)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, H.op11_hard_negatives(spark, SF).collect())) == sorted(con.sql(H.SQL).fetchall())
