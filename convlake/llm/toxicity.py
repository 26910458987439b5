"""Op 4. Toxicity by class-conditional Kneser-Ney models.

Two bigram models with absolute discounting, one of toxic and one of ordinary text, back off to counts
of contexts within their class and from there to counts of contexts that both share, so an expression
that is rare in either weighs the same in both. The discount of a class grows with its size, so that the
larger sample doesn't look richer. A text's evidence is its log-likelihood ratio, divided by length, over
the whole text and over the passage where it is highest; a logistic curve through documents that the
models haven't seen turns both into a probability and picks discount, order and length of passage. The
models are fitted on a bounded sample of labelled documents; every text is scored whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, remainder, staged, word_count, work_dir
from .hashed import drawn, texts_of

#: Labelled documents of each class to learn from; a third of them only sets the curve.
PER_CLASS = 3000
#: Words of each class to learn from, so that long documents are bounded too.
CLASS_WORDS = 4_000_000
DISCOUNTS = (1.0, 2.0, 4.0, 8.0, 16.0)
ORDERS = (1, 2)
#: Words of a passage.
PASSAGES = (1, 2, 3, 5)
START = b"<s>"

_MARKS = bytes(32 if not (chr(b).isalnum() or b > 127) else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII marks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split() if text else []


class Counts(NamedTuple):
    """By class (0 ordinary, 1 toxic): bigrams seen twice or more, contexts of them, words by contexts."""

    words: dict[bytes, int]
    #: sorted keys (first * (V + 1) + second) and counts, by class
    pairs: list
    pair_counts: list
    #: by class, over first words (V + 1): all bigrams after it, and how many different
    after: list
    after_kinds: list
    #: by class, over words (V + 1, the last for all others): different words before it
    before: list
    kinds: list[int]


def count(sample: DataFrame) -> Counts:
    """Counts of ``sample`` (text, toxic), a table of a stated bound.

    They come to the driver as columns of Arrow tables, never as one object for each bigram.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def bigrams(batches):
        import pandas as pd
        from collections import Counter

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                w = tokens(text)
                found = Counter(zip([START, *w], w, strict=False))
                if found:
                    yield pd.DataFrame({"toxic": int(toxic), "a": [a for a, _ in found], "b": [b for _, b in found], "n": list(found.values())})

    folder = work_dir(sample.sparkSession)
    pairs = sample.mapInPandas(bigrams, "toxic int, a binary, b binary, n long").groupBy("toxic", "a", "b").agg(F.sum("n").alias("n"))
    pairs = staged(pairs, f"{folder}/bigrams")
    often = pairs.where("n > 1").select("toxic", "a", "b", "n").toArrow()
    seen = pairs.groupBy("b").agg(*(F.count_if(F.col("toxic") == c).alias(f"k{c}") for c in (0, 1)), F.max("n").alias("most")).where("k0 + k1 > 1 or most > 1").drop("most").toArrow()
    firsts = pairs.join(F.broadcast(pairs.where("n > 1").select("toxic", "a").distinct()), ["toxic", "a"]).groupBy("toxic", "a").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()
    kinds = {r["toxic"]: r["count"] for r in pairs.groupBy("toxic").count().collect()}
    discard(sample.sparkSession, folder)

    binary = lambda table, name: table[name].combine_chunks().cast(pa.binary())
    known = pc.unique(pa.concat_arrays([pa.array([START], pa.binary()), binary(seen, "b"), binary(often, "a"), binary(often, "b")]))
    known = known.take(pc.sort_indices(known))
    place = lambda table, name: pc.index_in(binary(table, name), known).to_numpy(zero_copy_only=False).astype("int64")
    v = len(known)
    before, after, after_kinds = ([np.zeros(v + 1) for _ in (0, 1)] for _ in range(3))
    at = place(seen, "b")
    first, toxic = place(firsts, "a"), firsts["toxic"].to_numpy()
    key, of, many = place(often, "a") * (v + 1) + place(often, "b"), often["toxic"].to_numpy(), often["n"].to_numpy()
    keys, ns = [], []
    for c in (0, 1):
        before[c][at] = seen[f"k{c}"].to_numpy()
        after[c][first[toxic == c]] = firsts["n"].to_numpy()[toxic == c]
        after_kinds[c][first[toxic == c]] = firsts["k"].to_numpy()[toxic == c]
        order = np.argsort(key[of == c])
        keys.append(key[of == c][order])
        ns.append(many[of == c][order].astype("float64"))
    return Counts({w: k for k, w in enumerate(known.to_pylist())}, keys, ns, after, after_kinds, before, [kinds.get(0, 0), kinds.get(1, 0)])


class Ratio:
    """Log of the toxic over the ordinary probability of each word of a text.

    ``order`` 2 has the bigrams, 1 only the distributions they back off to.
    """

    def __init__(self, counts: Counts, discount: float, order: int = 2):
        import numpy as np

        self.counts, self.v, self.order = counts, len(counts.words), order
        self.discounts = [discount * max(1, k) / max(1, min(counts.kinds)) for k in counts.kinds]
        both = counts.before[0] + counts.before[1]
        # what words outside the list have, as one word among the others
        both[-1] = max(1.0, sum(counts.kinds) - both.sum())
        shared = both / both.sum()
        self.lower, self.left = [], []
        for c, cut in enumerate(self.discounts):
            own = np.maximum(counts.before[c] - cut, 0) / max(1, counts.kinds[c])
            self.lower.append(own + (1 - own.sum()) * shared)
            over = np.zeros(self.v + 1)
            np.add.at(over, counts.pairs[c] // (self.v + 1), np.maximum(counts.pair_counts[c] - cut, 0))
            after = counts.after[c]
            self.left.append(np.where(after > 0, 1 - over / np.maximum(after, 1), 1.0))

    def words(self, found: list[bytes]):
        import numpy as np

        get, v = self.counts.words.get, self.v
        at = np.array([get(w, v) for w in [START, *found]], "int64")
        first, second = at[:-1], at[1:]
        if self.order == 1:
            return np.log(self.lower[1][second]) - np.log(self.lower[0][second])
        key, logs = first * (v + 1) + second, []
        for c, cut in enumerate(self.discounts):
            p = self.left[c][first] * self.lower[c][second]
            pairs = self.counts.pairs[c]
            if len(pairs):
                place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                hit = pairs[place] == key
                p[hit] += np.maximum(self.counts.pair_counts[c][place[hit]] - cut, 0) / self.counts.after[c][first[hit]]
            logs.append(np.log(p))
        return logs[1] - logs[0]

    def evidence(self, text: str | None, passages: tuple[int, ...]) -> list[float]:
        """Mean ratio over the text, and over its most toxic passage of each length."""
        import numpy as np

        found = tokens(text)
        if not found:
            return [0.0] * (1 + len(passages))
        ratio = self.words(found)
        sums = np.concatenate(([0.0], np.cumsum(ratio)))
        out = [float(ratio.mean())]
        for words in passages:
            n = min(words, len(ratio))
            out.append(float((sums[n:] - sums[:-n]).max() / words))
        return out


def curve(x, y, rounds: int = 50):
    """Weights (the last is the offset) of a logistic curve, by Newton steps with a small ridge."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.01] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Model(NamedTuple):
    ratio: Ratio
    passage: int
    weights: object

    def score(self, text: str | None) -> float:
        import math

        mean, passage = self.ratio.evidence(text, (self.passage,))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] * mean + self.weights[1] * passage + self.weights[2]))))


def bounded(rows: DataFrame, words: int) -> DataFrame:
    """Of ``rows`` (doc_id, text, toxic), by class the first by hash until they have ``words`` words."""
    sizes = rows.select("doc_id", "toxic", word_count(F.col("text")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.withColumn("before", before).where(F.col("before") < words).select("doc_id")
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5, words: int = CLASS_WORDS) -> Model | None:
    """A model from the labelled rows whose id doesn't have remainder 0; None without both classes.

    Of one document with both labels, and of equal texts with both, the toxic one counts.
    """
    import numpy as np

    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    known = labels.where((remainder(F.col("doc_id"), modulus) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    rows = staged(texts_of(docs, drawn(known, "toxic", per_class)).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), f"{folder}/texts")
    rows = staged(bounded(rows, words).withColumn("curve", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0), f"{folder}/sample")
    counts = count(rows.where("not curve").select("text", "toxic"))
    if not all(counts.kinds):
        discard(spark, folder)
        return None
    tried = [(d, order) for d in DISCOUNTS for order in ORDERS]
    shared = spark.sparkContext.broadcast(counts)

    def measure(batches):
        import pandas as pd

        ratios = [Ratio(shared.value, d, order) for d, order in tried]
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"].astype("int32"), "x": [[v for r in ratios for v in r.evidence(t, PASSAGES)] for t in pdf["text"]]})

    seen = rows.where("curve").select("text", "toxic").mapInPandas(measure, "toxic int, x array<double>").collect()  # per_class rows at most
    shared.destroy()
    discard(spark, folder)
    y = np.array([r["toxic"] for r in seen], "float64")
    if not 0 < y.sum() < len(y):
        return Model(Ratio(counts, *tried[0]), PASSAGES[0], np.array([1.0, 1.0, -1.0]))
    x = np.array([r["x"] for r in seen]).reshape(len(seen), len(tried), 1 + len(PASSAGES))
    curves = [(*curve(x[:, k][:, [0, 1 + n]], y)[::-1], k, n) for k in range(len(tried)) for n in range(len(PASSAGES))]
    _, weights, k, n = min(curves, key=lambda t: t[0])
    # as often as among all labelled rows, not as in the sample
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights[2] += np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(Ratio(counts, *tried[k]), PASSAGES[n], weights)


def toxic_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, Column]:
    """``docs`` as it is, and its score (0 to 1) as a column over ``text``.

    Null and empty texts have no evidence and get what the curve gives for none. Without labels of both
    classes every score is 0. Rows that repeat are scored one by one; an id may be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        model = shared.value
        return pd.Series([0.0 if model is None else model.score(t) for t in texts], dtype="float64")

    return docs, score(F.col("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with a column ``toxic_score`` (a column of that name gives way)."""
    docs, score = toxic_scores(docs, labels, per_class)
    return docs.withColumn("toxic_score", score)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns as they are."""
    docs, score = toxic_scores(docs, labels)
    return docs.where(score < 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = remainder(F.col("doc_id"), 5) == 0
    return found.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
