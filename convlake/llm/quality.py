"""Op 8. Quality by ordinal cumulative-link regression on graded ratings.

All grades share the weights of hashed text features; ordered thresholds cut their sum into grades, so
P(grade <= k) = logistic(threshold k - sum). That gives every text an expected grade and the probability
of each tail. The model is fitted on a bounded sample of rated documents; every text is read whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder
from .hashed import BITS, code_points, dense, drawn, grams, sparse, texts_of

#: Rated documents of each grade to learn from at most, over all grades about, and of each grade at least.
PER_GRADE = 1000
SAMPLE = 4000
LEAST = 20
ROUNDS = 300
RIDGE = 1e-3


def features(text: str):
    """Ids and values: shares of the runs of three characters, and marks for coarse measures."""
    import numpy as np

    codes = code_points(text)
    k = grams(codes, (3,))
    words = text.split()
    n = max(1, len(words))
    measures = (
        min(12, int(np.log2(n))),
        round(10 * len(set(words)) / n),
        round(10 * sum(map(str.isupper, words)) / n),
        min(20, round(len(codes) / n)),
        round(10 * sum(not w[-1].isalnum() for w in words) / n),
    )
    marks = np.concatenate([grams(np.array([1 << 20, i, m]), (3,)) for i, m in enumerate(measures)])
    return np.concatenate([k, marks]), np.concatenate([np.full(len(k), 30.0 / max(1, len(k))), np.full(len(marks), 0.5)])


class Model(NamedTuple):
    """``grades`` in order, ``weights`` by feature, ``cuts`` between the grades."""

    grades: list[int]
    weights: object
    cuts: object

    def tails(self, text: str):
        """P(grade > k) for every grade but the last."""
        import numpy as np

        k, v = features(text)
        return 1 / (1 + np.exp(np.clip(self.cuts - float((self.weights[k] * v).sum()), -30, 30)))


def fit(x, y, grades: list[int], rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Weights and thresholds of greatest likelihood, by Adam steps over the whole sample.

    The first threshold is free; the others are sums of positive steps, which keeps them in order.
    """
    import numpy as np

    place = np.searchsorted(grades, y)
    m = len(grades) - 1
    if m < 1:
        return Model(list(grades), np.zeros(x.shape[1], "float32"), np.zeros(0))
    shares = np.clip(np.cumsum(np.bincount(place, minlength=m + 1))[:-1] / len(y), 0.01, 0.99)
    start = np.log(shares / (1 - shares))
    first, steps = start[0], np.log(np.maximum(np.diff(start), 0.1))
    params = np.concatenate([np.zeros(x.shape[1]), [first], steps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        cuts = params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])
        s = x @ params[:d].astype(x.dtype)
        upper = np.where(place < m, sigma(cuts[np.minimum(place, m - 1)] - s), 1.0)
        lower = np.where(place > 0, sigma(cuts[np.maximum(place - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_cut = np.zeros(m)
        np.add.at(by_cut, np.minimum(place, m - 1), -up * (place < m))
        np.add.at(by_cut, np.maximum(place - 1, 0), low * (place > 0))
        grad = np.concatenate([x.T @ ((up - low) / len(y)).astype(x.dtype) + ridge * params[:d], [by_cut.sum() / len(y)], [by_cut[k:].sum() * np.exp(params[d + k]) / len(y) for k in range(1, m)]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Model(list(grades), params[:d].astype("float32"), params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))]))


def learn(docs: DataFrame, ratings: DataFrame, column: str, per_grade: int = PER_GRADE, modulus: int = 5) -> Model | None:
    """A model of the integer grades in ``column``, from rows whose id doesn't have remainder 0."""
    import numpy as np

    known = ratings.where(remainder(F.col("doc_id"), modulus) != 0).select("doc_id", F.col(column).cast("int").alias("grade"))
    grades = known.where("grade is not null").agg(F.count_distinct("grade")).first()[0]
    per_grade = min(per_grade, max(LEAST, SAMPLE // max(1, grades)))
    x, grades = dense(sparse(texts_of(docs, drawn(known, "grade", per_grade)).select("text", "grade"), features, "grade"))
    y = np.array([int(float(g)) for g in grades], "int64")
    if not len(y):
        return None
    model = fit(x, y, sorted(set(y.tolist())))
    if len(model.grades) == 2:  # the sample has both grades alike; the threshold goes to how often they are
        all_of = {r["grade"]: r["count"] for r in known.where("grade is not null").groupBy("grade").count().collect()}
        drawn_of = np.bincount(np.searchsorted(model.grades, y))
        shift = np.log(all_of[model.grades[0]] / all_of[model.grades[1]]) - np.log(drawn_of[0] / drawn_of[1])
        model = model._replace(cuts=model.cuts + shift)
    return model


def rate(docs: DataFrame, ratings: DataFrame, column: str = "quality", per_grade: int = PER_GRADE) -> DataFrame:
    """doc_id, held_out, expected_grade, top_prob (of the highest grade) and tails of every row.

    Null texts are empty texts. Without ratings the three are null; with one grade it is expected. Any
    number of grades is learned. A document with several ratings has the largest; a repeated row is answered
    as often as it comes. Other columns are not looked at.
    """
    model = learn(docs, ratings, column, per_grade)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = remainder(F.col("doc_id"), 5) == 0

    def rates(batches):
        import numpy as np
        import pandas as pd

        model = shared.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if model is None:
                    out.append((None, None, None))
                    continue
                tails = model.tails("" if text is None else text)
                grades = np.array(model.grades, "float64")
                out.append((float(grades[0] + (np.diff(grades) * tails).sum()), float(tails[-1]) if len(tails) else 1.0, tails))
            found = pd.DataFrame(out, columns=["expected_grade", "top_prob", "tails"])
            found.insert(0, "held_out", pdf["held_out"].to_numpy(bool))
            found.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    return rows.mapInPandas(rates, "doc_id long, held_out boolean, expected_grade double, top_prob double, tails array<double>")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of all documents."""
    rows = rate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "held_out", "expected_grade", F.col("top_prob").alias("score"), (F.col("top_prob") >= 0.5).cast("int").alias("predicted"), (F.col("top_prob") >= 0.5).alias("kept"))
