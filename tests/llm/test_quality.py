import numpy as np
import pytest

from convlake.llm.hashed import drawn
from convlake.llm.quality import features, fit, learn, op8_ordinal_quality, rate

from .data import SF, awkward, clashing, table

RATINGS = "doc_id long, quality int, toxic int"


def test_fit_finds_ordered_grades():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 4)).astype("float32")
    w, cuts = np.array([1.5, -1.0, 0.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    s = x @ w + r.logistic(size=3000)
    y = np.array([1, 2, 4, 7])[(s[:, None] > cuts).sum(axis=1)]
    model = fit(x, y, [1, 2, 4, 7], rounds=800, ridge=0)
    assert model.weights == pytest.approx(w, abs=0.2) and model.cuts == pytest.approx(cuts, abs=0.2)
    assert (np.diff(model.cuts) > 0).all()


def test_features_take_any_text():
    for text in ("", " ", "a", "\U0001f600", "A!! B!!"):
        k, v = features(text)
        assert len(k) == len(v)


def test_awkward(spark):
    ratings = spark.createDataFrame([(d, d % 4, 0) for d, *_ in awkward() if d is not None] + [(None, 1, 1), (11, None, 0), (777, 9, 0)], RATINGS)
    docs = clashing(table(spark))
    rows = rate(docs, ratings).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert 0 <= r.expected_grade <= 3 and 0 <= r.top_prob <= 1
        assert r.tails == sorted(r.tails, reverse=True) and len(r.tails) == 3
    assert rate(table(spark, []), ratings).count() == 0
    assert {r.top_prob for r in rate(docs, ratings.limit(0)).collect()} == {None}


def test_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(marks[r.doc_id], r.predicted) for r in op8_ordinal_quality(spark, sf).collect() if r.held_out and r.doc_id in marks]
    good, bad = [x for x in seen if x[0]], [x for x in seen if not x[0]]
    assert sum(x[1] for x in good) > 0.97 * len(good)
    assert sum(not x[1] for x in bad) > 0.8 * len(bad)


def test_all_grades_are_drawn(spark):
    labels = spark.createDataFrame([(i, i % 101 if i < 4000 else 50) for i in range(9000)], "doc_id long, grade int")
    found = drawn(labels, "grade", 20).groupBy("grade").count().collect()
    assert {r["grade"]: r["count"] for r in found} == dict.fromkeys(range(101), 20)


def plain_run(codes):
    h = len(codes)
    for c in codes:
        h = (h + c) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 32
    return (h >> 8) % 2**14


def plain_sum(text, weights):
    """The sum of the weights of a text, feature by feature."""
    codes, words = [ord(c) for c in text], text.split()
    runs = [plain_run(codes[i : i + 3]) for i in range(len(codes) - 2)]
    n = max(1, len(words))
    measures = (min(12, int(np.log2(n))), round(10 * len(set(words)) / n), round(10 * sum(w.isupper() for w in words) / n), min(20, round(len(codes) / n)), round(10 * sum(not w[-1].isalnum() for w in words) / n))
    marks = [plain_run([1 << 20, i, m]) for i, m in enumerate(measures)]
    return sum(30 * float(weights[k]) for k in runs) / max(1, len(runs)) + sum(float(weights[k]) for k in marks) / 2


def test_rating_by_definition(spark):
    """Expected grade and tails of every row, from the probability of each grade."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = docs.selectExpr("doc_id", "case when length(text) < 300 then 1 when length(text) < 700 then 2 else 5 end quality")
    model = learn(docs, words, "quality", 40)
    assert model.grades == [1, 2, 5]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = rate(docs, words, "quality", 40).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = plain_sum(texts[r.doc_id], model.weights)
        below = [1 / (1 + np.exp(s - c)) for c in model.cuts]
        of = [below[0], below[1] - below[0], 1 - below[1]]
        assert r.expected_grade == pytest.approx(of[0] + 2 * of[1] + 5 * of[2], abs=1e-4)
        assert r.top_prob == pytest.approx(of[2], abs=1e-4) and r.tails == pytest.approx([1 - b for b in below], abs=1e-4)


def test_many_grades_share_one_sample(spark, monkeypatch):
    from convlake.llm import quality

    monkeypatch.setattr(quality, "SAMPLE", 60)
    monkeypatch.setattr(quality, "LEAST", 2)
    docs = table(spark, [(i, f"text {i % 30} " * (1 + i % 30), "en", "s", 1) for i in range(900)])
    ratings = spark.createDataFrame([(i, i % 30, 0) for i in range(900)], RATINGS)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, grades: seen.append(y) or fit(x, y, grades, rounds=3))
    learn(docs, ratings, "quality")
    assert sorted(seen[0]) == sorted([*range(30)] * 2)
