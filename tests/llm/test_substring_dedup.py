import hashlib
import random
import re

import duckdb
import pytest

from convlake.llm import substring_dedup as S
from convlake.llm.fm_index import NONE, FMIndex

from .data import SF, clashing, table


def plain(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [1 << 63 if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            least[t] = min(i, least.get(t, i))
    out = []
    for (doc, _), i, w in zip(rows, ids, words, strict=True):
        gone = {k + j for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for j in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def documents(rnd, n, vocabulary, passages=6):
    pool = [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 30))] for _ in range(passages)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(pool) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 15))]
        rows.append((i, rnd.choice(" \n\t").join(w)))
    return rows


@pytest.mark.parametrize("width", [2, 3, 8, 50])
def test_index(width):
    r = random.Random(width)
    words = [b"a", b"b", "é".encode(), b"dd"]
    for n in (1, 40):
        own = [b" ".join(r.choice(words) for _ in range(r.randint(1, 3 * width))) for _ in range(n)]
        labels = [r.randrange(20) for _ in own]
        asked = own + [b" ".join(r.choice([*words, b"new"]) for _ in range(3 * width)) for _ in range(20)] + [b"new", b"a"]
        known = {}
        for s, label in zip(own, labels, strict=True):
            w = s.split(b" ")
            for k in range(len(w) - width + 1):
                t = tuple(w[k : k + width])
                known[t] = min(label, known.get(t, label))
        found, first = FMIndex(own, labels, width).windows(asked)
        for s, a, b in zip(asked, first, first[1:], strict=False):
            w = s.split(b" ")
            assert [known.get(tuple(w[k : k + width]), NONE) for k in range(len(w) - width + 1)] == found[a:b].tolist()


def test_segments_cover_all_windows_and_follow_content(monkeypatch):
    r = random.Random(1)
    words = [b"w%d" % r.randrange(9) for _ in range(400)]
    monkeypatch.setattr(S, "CHUNK", 64)
    first, number, anchors = S.segments(b" ".join(words), 12, 3)
    assert first[0] == 0 and (first[1:] == (first + number)[:-1]).all() and first[-1] + number[-1] == len(words) - 11
    of = {}
    for f, n, a in zip(first, number, anchors, strict=True):
        for k in range(f, f + n):
            assert of.setdefault(tuple(words[k : k + 12]), a) == a
    monkeypatch.setattr(S, "CHUNK", 1 << 20)
    again = S.segments(b"x " + b" ".join(words[100:]), 12, 3)
    for f, n, a in zip(*again, strict=True):
        for k in range(max(f, 1), f + n):
            assert of[tuple(words[99 + k : 111 + k])] == a


@pytest.mark.parametrize("hot", [4096, 1])
def test_random_and_awkward(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD_WORDS", 600)
    r = random.Random(hot)
    rows = documents(r, 120, [f"w{k}" for k in range(40)]) + documents(r, 30, ["a", "b"])
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, " ".join(["same"] * 300)), (504, " ".join(["same"] * 200)), (None, rows[5][1] + " x " + rows[6][1]), (None, rows[5][1]), (7, rows[8][1]), (7, rows[7][1]), (7, rows[7][1]), (505, "x" * 200_000 + " y"), (506, "\u00a0".join(["joined"] * 40) + " \x1f \x85 é")]
    rows += [(600 + i, rows[9][1] + f" end {i % 3}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.without_repeats(docs, 9).collect()), key=str) == plain(rows, 9)


def test_shared_table_of_cases(spark):
    docs = clashing(table(spark))
    for name in ("rid", "ord", "whole", "mark", "first", "segment", "least"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, S.without_repeats(docs).collect()), key=str) == plain(rows, 50)
    assert S.without_repeats(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, S.op12_substring_dedup(spark, SF).collect()))
    assert got == sorted(con.sql(S.SQL).fetchall())
    assert sum(r[2] for r in got) > 0
