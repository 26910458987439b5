"""Op 9. Language identification: the family first, then one-versus-one machines within it.

A text is the mean of its hashed runs of two and three letters. Linear support vector machines, one for
each pair, tell families apart, and another one for each pair the languages of a family. They are fitted
on a bounded sample of documents with a known language, one task for each; every text is read whole.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, staged, work_dir
from .hashed import BITS, code_points, first_by_hash, grams, letters, sparse

#: Documents to learn from, over all languages.
SAMPLE = 2400
SIZES = (2, 3)
UNKNOWN = "und"
#: Steepness with which a margin becomes a probability.
SLOPE = 3.0

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}


def family(lang: str) -> str:
    """The family of a language; one that isn't listed is a family of its own."""
    base = lang.lower().split("-")[0].split("_")[0]
    return next((name for name, members in FAMILIES.items() if base in members), f"={lang}")


def runs(text: str):
    """Hashes of the letter runs of ``text``; all else is one kind of gap."""
    import numpy as np

    codes = code_points(text.lower())
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32)
    gap = ~is_letter
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return grams(np.concatenate(([32], codes[keep], [32])), SIZES)


def features(text: str):
    import numpy as np

    k = runs(text)
    return k, np.full(len(k), 100.0 / max(1, len(k)))


def machine(rows, sign, width: int, c: float = 1.0, passes: int = 15):
    """Weights (the last is the offset) of a linear support vector machine, by dual coordinate descent.

    ``rows`` has the ids below ``width`` and the values of each example.
    """
    import numpy as np

    order, w = np.random.default_rng(7), np.zeros(width + 1)
    alpha, size = np.zeros(len(rows)), [float((v * v).sum()) + 1 for _, v in rows]
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = sign[i] * (float((v * w[at]).sum()) + w[-1]) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


class Model(NamedTuple):
    """``duels``: (level, first, second) of each column of ``weights``, whose last row is the offset."""

    languages: list[str]
    duels: list[tuple[str, str, str]]
    weights: object


def pairs(languages: list[str]) -> list[tuple[str, str, str]]:
    """All pairs of families (level "") and all pairs of languages within a family."""
    kin = sorted({family(a) for a in languages})
    levels = [("", kin)] + [(f, [a for a in languages if family(a) == f]) for f in kin]
    return [(level, a, b) for level, names in levels for a, b in combinations(names, 2)]


def train(spark: SparkSession, sample, width: int = 1 << BITS) -> Model:
    """Machines for all pairs, each fitted in a task that has the sample (rows of sparse(), of a stated bound)."""
    import numpy as np

    languages = sorted({r["label"] for r in sample})
    duels = pairs(languages)
    weights = np.zeros((width + 1, len(duels)), "float32")
    if not duels:
        return Model(languages, duels, weights)
    shared = spark.sparkContext.broadcast([tuple(r[c] for c in ("label", "ids", "v")) for r in sample])

    def fit(batches):
        import pandas as pd

        x = [(np.frombuffer(ids, "<i4"), np.frombuffer(v, "<f4").astype("float64")) for _, ids, v in shared.value]
        labels = [label for label, *_ in shared.value]
        for pdf in batches:
            for k in pdf["id"]:
                level, a, b = duels[k]
                of = labels if level else [family(label) for label in labels]
                at = [i for i, name in enumerate(of) if name in (a, b)]
                w = machine([x[i] for i in at], [1 if of[i] == a else -1 for i in at], width)
                yield pd.DataFrame({"id": [k], "w": [w.astype("<f4").tobytes()]})

    parts = min(len(duels), 4 * spark.sparkContext.defaultParallelism)
    for row in spark.range(0, len(duels), 1, parts).mapInPandas(fit, "id long, w binary").toLocalIterator():
        weights[:, row["id"]] = np.frombuffer(row["w"], "<f4")
    shared.destroy()
    return Model(languages, duels, weights)


def decide(model: Model, margins) -> tuple[str, float]:
    """The language that wins most duels of its family, the family having won its own; and how clearly."""
    import math

    def winner(level: str, names: list[str]) -> tuple[str, float]:
        won, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (at, a, b), m in zip(model.duels, margins, strict=True):
            if at == level and a in won and b in won:
                won[a if m >= 0 else b] += 1
                for name, own in ((a, m), (b, -m)):
                    total[name] += own
                    least[name] = min(least[name], 1 / (1 + math.exp(-max(-50.0, min(50.0, SLOPE * own)))))
        best = max(names, key=lambda x: (won[x], total[x]))
        return best, least[best]

    kin, sure = winner("", sorted({family(a) for a in model.languages}))
    lang, sure_too = winner(kin, [a for a in model.languages if family(a) == kin])
    return lang, sure * sure_too


def sampled(known: DataFrame, sample: int) -> DataFrame:
    """doc_id, text and lang of the rows to learn from: an equal share of each language, at least four.

    All languages that occur are in it. Rows are drawn by hash; those that repeat count once.
    """
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("_n"))
    sizes = staged(sizes, f"{work_dir(known.sparkSession)}/languages")
    return first_by_hash(known, "lang", sizes, ["doc_id", "text"], max(4, sample // max(1, sizes.count())))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Rows whose id has remainder 1 by 3 are held out of learning. Null texts, texts without a letter and
    all texts where there is nothing to learn from are ``und`` with score 0. A repeated row counts once in
    learning and is answered as often as it comes. Other columns are not looked at.
    """
    import numpy as np

    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), 3) == 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    known = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = spark.sparkContext.broadcast(train(spark, sparse(sampled(known, sample).select("text", "lang"), features, "lang")))

    def predict(batches):
        import pandas as pd

        model = shared.value
        weights, offset = model.weights[: 1 << BITS], model.weights[-1].astype("float64")
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if not text or not model.languages or not letters()[code_points(text)].any():
                    out.append((UNKNOWN, 0.0))
                    continue
                k = runs(text)
                out.append(decide(model, np.bincount(k, minlength=1 << BITS) @ weights * (100.0 / len(k)) + offset))
            found = pd.DataFrame(out, columns=["lang_pred", "score"])
            found.insert(0, "held_out", pdf["held_out"].to_numpy(bool))
            found.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield found

    return docs.select("doc_id", "text", "held_out").mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
