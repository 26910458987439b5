import random

import pytest

from convlake.llm import jaccard
from convlake.llm.graph import components
from convlake.llm.jaccard import jaccard_components, one_of_each, op6_jaccard_join

from .data import DOCS, SF, awkward, clashing, table


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def plain(docs, percent=90):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(s), -1 if (c := least.get(find(i))) is None else c) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def near_copies(seed=4):
    """Groups of near copies with few true links each, a text that all share, and chains."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(12)]
    docs = []
    for size, length, edits in ((60, 150, 4), (40, 60, 1), (8, 30, 1), (2, 300, 5), (2, 12, 0)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            docs.append(w)
    base = [word() for _ in range(80)]
    for i in range(30):  # each like the next, the ends unlike
        docs.append(base[i:] + [f"new{k}" for k in range(i)])
    docs += [line + [word() for _ in range(r.randint(0, 40))] for _ in range(60)] + [line] * 3
    r.shuffle(docs)
    return [(1000 + i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("few", [250_000, 0])
def test_components(spark, monkeypatch, few):
    """Also with every filter by key as a shuffled join."""
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", few)
    docs = [(d, t) for d, t, *_ in awkward()] + near_copies()
    df = clashing(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS))
    assert got(jaccard_components(df.repartition(3))) == plain(docs)


def test_few_words(spark):
    docs = [(1, "a b"), (2, "A  b"), (3, "a"), (4, "a b c"), (5, "b a"), (6, None), (7, "")]
    assert got(jaccard_components(table(spark, [(d, t, None, None, None) for d, t in docs]))) == plain(docs)
    assert jaccard_components(table(spark, [])).count() == 0


def test_one_of_each(spark):
    docs = near_copies(7)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS)
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in plain(docs)})


def test_long_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (700, 700)], "u long, v long")
    rows = {r.node: r.root for r in components(edges, str(tmp_path)).collect()}
    assert rows == {i: 0 for i in range(201)} | {499: 499, 500: 499}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op6_jaccard_join(spark, SF)) == plain(docs)


def test_one_of_each_row(spark):
    """Ids that repeat, or are null, with other texts: components decide, not ids."""
    r = random.Random(9)
    long = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (long() for _ in range(5))
    near = lambda t: t + " more"
    docs = [(1, a), (5, near(a)), (5, b), (7, c), (7, near(c)), (None, d), (None, near(d)), (None, e), (9, e), (9, e), (3, "x"), (3, None), (1, long())]
    out = [(x.doc_id, x.text) for x in one_of_each(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)).collect()]
    assert (1, a) in out and (5, near(a)) not in out and (5, b) in out and docs[-1] in out
    assert len([x for x in out if x[0] == 7]) == 1 and len([x for x in out if x[0] is None]) == 1
    assert out.count((9, e)) == 1 and (None, e) not in out and {(3, "x"), (3, None)} <= set(out)
    assert len(out) == 8
