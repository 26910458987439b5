"""Op 1. Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole passes over the source go in first; what is left of the
target is fitted from counts of documents by exact length: an equal share of every length, then a
bounded-knapsack dynamic program over the small budget that remains, up or down to the nearest sum. The counts are then filled with
documents in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, staged, whole_rows, word_count, work_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20_231
#: Words that are left to the dynamic program.
SPAN = 1 << 16
#: Documents of one source and length are ranked in so many parts.
SALTS = 64


def fit_budget(lengths, counts, budget: int, span: int = SPAN):
    """How many of each length to take so that the words come to ``budget`` or as near as can be.

    ``lengths`` are distinct and positive, ``counts`` what there is of each, in numpy arrays.
    """
    import numpy as np

    lengths, counts = np.asarray(lengths, "int64"), np.asarray(counts, "int64")
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    exact = counts * (budget / total)
    take = np.floor(exact).astype("int64")
    rest = budget - int((take * lengths).sum())
    while rest < 0:  # rounding of very large products
        k = int(np.argmax(take * lengths))
        take[k] -= 1
        rest += int(lengths[k])
    order = np.lexsort((lengths, -(exact - take)))
    order = order[take[order] < counts[order]]
    more = int(np.searchsorted(np.cumsum(lengths[order]), rest - span, "right")) if rest > span else 0
    take[order[:more]] += 1
    rest -= int(lengths[order[:more]].sum())

    room = rest + min(int(lengths.max()), span)  # the nearest sum may lie above
    reach, origin, parts = np.zeros(room + 1, bool), np.zeros(room + 1, "int32"), []
    reach[0] = True
    for k in np.argsort(-lengths):
        spare = min(int(counts[k] - take[k]), room // int(lengths[k]))
        n = 1
        while spare > 0 and not reach[rest]:
            n = min(n, spare)
            width = n * int(lengths[k])
            new = np.flatnonzero(reach[:-width] & ~reach[width:]) + width
            reach[new], origin[new] = True, len(parts)
            parts.append((k, n, width))
            spare, n = spare - n, 2 * n
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        k, n, width = parts[origin[at]]
        take[k] += n
        at -= width
    return take


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (one row per source: source, source_size) with its target.

    Weights are given out in turn to the sources by code point, null last. ``share`` of all words is
    dealt by weight; a source stops at ``most`` times its size and the excess is dealt again. The level
    at which that ends is found from running sums over the sources in the order in which they stop.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turns = F.array(*(F.lit(float(w)) for w in weights))
    dealt = sizes.withColumn("nth", nth).withColumn("weight", F.element_at(turns, (F.col("nth") - 1) % len(weights) + 1)).withColumn("top", F.lit(most) * F.col("source_size"))
    dealt = dealt.withColumn("stops", F.col("top") / F.col("weight"))
    order, everything = Window.orderBy("stops", "nth"), Window.partitionBy()
    full = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    dealt = dealt.withColumn("level", (F.lit(min(share, most)) * F.sum("source_size").over(everything) - full) / open_weight)
    level = F.min_by("level", F.when(F.col("level") <= F.col("stops"), F.struct("stops", "nth"))).over(everything)
    return dealt.withColumn("end", F.coalesce(level, F.max("stops").over(everything))).select("source", "source_size", F.least(F.col("top"), F.col("weight") * F.col("end")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of ``docs``.

    ``copies`` is how often the row is in the mix, ``taken`` its words there. Null and empty texts have
    size 0 and are never taken; a null source is a source of its own; repeated rows are ranked one by
    one. Rows are chosen by hash of seed and doc_id, so reruns agree.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.lit(seed), F.col("doc_id"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sized = docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), tie.alias("tie"), F.pmod(tie, F.lit(SALTS)).cast("int").alias("salt"))
    sized = staged(sized, f"{work_dir(spark)}/sized")
    cells = sized.groupBy("key", "source", "size", "salt").agg(F.count("*").alias("n"))
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("passes", passes).withColumn("budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size"))).withColumn("key", key).drop("source")
    lengths = cells.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n"))

    def fit(pdf):
        pdf = pdf.sort_values("size")
        pdf["take"] = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pdf[["key", "size", "take"]]

    chosen = lengths.join(goals.select("key", "budget"), "key").groupBy("key").applyInPandas(fit, "key string, size long, take long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = cells.join(chosen, ["key", "size"], "left").withColumn("quota", F.greatest(F.lit(0), F.coalesce("take", F.lit(0)) - before)).join(goals, "key")
    quotas = quotas.select("key", "size", "salt", "quota", "passes", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("tie", "doc_id"))
    ranked = sized.withColumn("rank", rank).join(quotas, ["key", "size", "salt"])
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("rank") <= F.col("quota")).cast("long")).otherwise(0)
    return ranked.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever these are called.

    Rows that agree in doc_id, source and size share what the mix gives them, the first by hash of their
    text get one copy more: no more words than the mix decided. The decisions are one short row per
    document; their number is checked before they go to every executor.
    """
    spark = docs.sparkSession
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("copies"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    taken = staged(taken.where("copies > 0 or more > 0"), f"{work_dir(spark)}/copies")
    uneven = not taken.where("more > 0").isEmpty()
    small = taken.count() <= BROADCAST_KEYS
    keyed = docs.select(whole_rows(docs), F.col("doc_id").alias("d"), F.col("source").alias("s"), word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("tie"))
    on = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    rows = keyed.join(F.broadcast(taken) if small else taken, on).select("row", "d", "s", "n", "tie", "copies", "more")
    if uneven:
        rank = F.row_number().over(Window.partitionBy("d", "s", "n").orderBy("tie"))
        shared = rows.where("more > 0").withColumn("copies", F.col("copies") + (rank <= F.col("more")).cast("long"))
        rows = rows.where("more = 0").unionByName(shared).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
