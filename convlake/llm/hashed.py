"""Hashed features of whole texts, and bounded samples of labelled rows, for the classifiers here."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS

BITS = 14


@functools.lru_cache(maxsize=1)
def letters():
    """Whether each code point is a letter."""
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str):
    """The code points of ``text``; lone surrogates are passed through."""
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes, sizes: tuple[int, ...], bits: int = BITS):
    """Hashes below 2 ** ``bits`` of every run of the given sizes in ``codes``."""
    import numpy as np

    codes = codes.astype("uint64")
    out = []
    with np.errstate(over="ignore"):
        for n in sizes:
            h = np.full(max(0, len(codes) - n + 1), n, "uint64")
            for k in range(n):
                h = (h + codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out.append((h >> np.uint64(8)) & np.uint64((1 << bits) - 1))
    return np.concatenate(out).astype("int64") if out else np.zeros(0, "int64")


def first_by_hash(rows: DataFrame, label: str, sizes: DataFrame, keys: list[str], per_label: int) -> DataFrame:
    """``label`` and the distinct ``keys`` that come first by their hash: at most ``per_label`` of each label.

    ``sizes`` has label and ``_n``, about how many there are. By it only a few more than needed are ranked.
    """
    few = sizes.count() <= BROADCAST_KEYS
    draw = F.xxhash64(*keys)
    share = F.least(F.lit(1.0), (2.0 * per_label + 100) / F.col("_n"))
    near = rows.join(F.broadcast(sizes) if few else sizes, label).where(draw.cast("double") <= (share - 0.5) * 2.0**64)
    order = Window.partitionBy(label).orderBy(draw, *keys)
    return near.select(*keys, label).distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")


def drawn(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """doc_id and ``label`` of at most ``per_label`` labelled documents of each label.

    All labels that occur are kept. Documents are drawn by hash; of several labels for one document the
    largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    return first_by_hash(known, label, known.groupBy(label).agg(F.count("*").alias("_n")), ["doc_id"], per_label)


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The text of each document of ``sample``, a table of a stated bound; one row per document."""
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return chosen.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in chosen.columns if c != "doc_id"))


def sparse(docs: DataFrame, features, label: str):
    """Features and labels of a bounded table, in driver memory: rows of label, ids and v (bytes of int32 and float32)."""

    def rows(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            ids, values = [], []
            for text in pdf["text"]:
                k, v = features("" if text is None else text)
                both = np.bincount(k, v)
                at = np.flatnonzero(both)
                ids.append(at.astype("<i4").tobytes())
                values.append(both[at].astype("<f4").tobytes())
            yield pd.DataFrame({"label": pdf[label].astype(str), "ids": ids, "v": values})

    return docs.mapInPandas(rows, "label string, ids binary, v binary").collect()


def dense(rows, bits: int = BITS):
    """A matrix of what sparse() gave, and its labels."""
    import numpy as np

    x = np.zeros((len(rows), 1 << bits), "float32")
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["ids"], "<i4")] = np.frombuffer(r["v"], "<f4")
    return x, [r["label"] for r in rows]
