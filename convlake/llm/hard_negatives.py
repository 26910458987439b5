"""Op 11. Hard negatives by Strassen multiplication of anchor and candidate tiles.

Anchors and candidates are written as tiles, 64-bit integer matrices of bounded size. A product of two
tiles splits both in halves, pads odd sides with a row or column of zeros, and takes seven products of
half the size in place of eight; sums are integer additions, which come out right in 64 bits even where a
step between runs over. A first pass over the products keeps a heap of the best rows of the anchor's label;
a second pass, which knows each positive's score, keeps a heap of the best rows of other labels for each
positive's window. Heaps of one anchor merge within each task, and tasks' heaps by rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, staged, work_dir

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Percent of the positive's score that a negative's lies between.
LOW, HIGH = 50, 95
ANCHORS = 512
CANDIDATES = 2048
#: Sides up to which a product isn't split.
LEAF = 32
#: Heaps that a task holds before it hands them on, in tiles of anchors.
HELD = 64

SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

TILE = "tile int, n int, dim int, ids binary, labels binary, data binary"


def labelled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (moved on by one where vec_id is divisible by 7) and v of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component take no part; rows that repeat
    an id, a label and a vector count once.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    there = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    return there.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).distinct()


def largest(m) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


def product(a, b):
    """``a @ b`` of 64-bit integers modulo 2 ** 64; by way of doubles where every sum is exact in them."""
    if a.shape[1] * largest(a) * largest(b) < 1 << 53:
        return (a.astype("float64") @ b.astype("float64")).astype("int64")
    return a @ b


def strassen(a, b, leaf: int = LEAF):
    """``a @ b`` by recursion on halves; sides that are odd get zeros, which are cut off again."""
    import numpy as np

    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return product(a, b)
    a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = (x // 2 for x in (a.shape[0], a.shape[1], b.shape[1]))  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6, p7 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), "int64")
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


def pack(rows) -> tuple:
    """n, dim, ids, labels and data of a tile, by id; shorter vectors end in zeros."""
    import numpy as np

    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    dim = max((len(r[2]) for r in rows), default=0)
    m = np.zeros((len(rows), dim), "<i8")
    for at, r in enumerate(rows):
        m[at, : len(r[2])] = r[2]
    small = largest(m) < 1 << 15
    return len(rows), dim, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), m.astype("<i2" if small else "<i8").tobytes()


def unpack(n: int, dim: int, ids: bytes, labels: bytes, data: bytes):
    import numpy as np

    kind = "<i2" if len(data) == 2 * n * dim else "<i8"
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(data, kind).reshape(n, dim).astype("int64")


def products(a, b):
    """Scores of the rows of ``a`` against those of ``b``."""
    import numpy as np

    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))
    return strassen(a, np.ascontiguousarray(b.T))


def best(scores, allowed, ids, k: int):
    """A heap for each row of ``scores``: ids, scores and whether there are as many, of the ``k`` best that are allowed.

    ``ids`` ascend, and the first of equal scores is taken, so ties go to the smaller id.
    """
    import numpy as np

    low = np.iinfo("int64").min
    left, rows = np.where(allowed, scores, low), np.arange(len(scores))
    allowed = allowed.copy()
    heap = np.zeros((3, len(scores), k), "int64")
    for at in range(min(k, scores.shape[1])):
        top = left.argmax(axis=1)
        there = allowed[rows, top]
        if (odd := ~there & allowed.any(axis=1)).any():  # a score that is the least long itself
            top[odd] = allowed[odd].argmax(axis=1)
            there = there | odd
        heap[0, :, at], heap[1, :, at], heap[2, :, at] = ids[top], scores[rows, top], there
        left[rows, top], allowed[rows, top] = low, False
    return heap


def merged(one, other, k: int):
    """The ``k`` best of two heaps of the same rows."""
    import numpy as np

    both = np.concatenate([one, other], axis=2)
    # the inverse of an integer descends where it ascends, and never runs over
    order = np.lexsort((both[0], np.invert(both[1]), -both[2]), axis=1)[:, :k]
    return np.take_along_axis(both, order[None], axis=2)


def _tiles(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (vec_id, label, v, tile) as one row of TILE per tile."""

    def tile(pdf):
        import pandas as pd

        return pd.DataFrame([(pdf["tile"].iloc[0], *pack(list(zip(pdf["vec_id"].tolist(), pdf["label"].tolist(), pdf["v"], strict=True))))], columns=["tile", "n", "dim", "ids", "labels", "data"])

    return staged(rows.groupBy("tile").applyInPandas(tile, TILE), path, 8)


def _heaps(pairs: DataFrame, k: int, allowed, schema: str) -> DataFrame:
    """One row for every member of each task's heaps: anchor_id, slot, vec_id and score.

    ``allowed(r, scores, own, ids, same)`` gives the masks of the heaps, by slot, for the pair of tiles ``r``.
    """

    def multiply(batches):
        import numpy as np
        import pandas as pd

        held = {}

        def told():
            for own, heaps in held.values():
                for slot, heap in heaps.items():
                    at, place = np.nonzero(heap[2])
                    yield pd.DataFrame({"anchor_id": own[at], "slot": slot, "vec_id": heap[0][at, place], "score": heap[1][at, place]})
            held.clear()

        for pdf in batches:
            for r in pdf.itertuples():
                own, labels, a = unpack(r.a_n, r.a_dim, r.a_ids, r.a_labels, r.a_data)
                ids, others, b = unpack(r.n, r.dim, r.ids, r.labels, r.data)
                scores, same = products(a, b), labels[:, None] == others[None, :]
                other_row = own[:, None] != ids[None, :]
                known = held.setdefault(r.a_tile, (own, {}))[1]
                for slot, mask in allowed(r, scores, same, other_row):
                    heap = best(scores, mask, ids, k)
                    known[slot] = merged(known[slot], heap, k) if slot in known else heap
                if len(held) >= HELD:
                    yield from told()
        yield from told()

    found = pairs.mapInPandas(multiply, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _paired(asks: DataFrame, tiles: DataFrame, anchors: int, candidates: int) -> DataFrame:
    """All pairs of an anchor tile with a candidate tile: the numbers are paired first, payloads follow by key."""
    ids = asks.select("a_tile").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    return ids.repartition("a_tile", "tile").join(tiles, "tile").join(asks, "a_tile")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of all anchors' windows.

    Anchors are the rows whose vec_id is divisible by ``every``; where an id has several rows, all are
    candidates of other ids and the smallest (label, vector) asks. Of two vectors of different sizes the
    shorter ends in zeros. Scores are 64-bit integers, modulo 2 ** 64 where they would be larger. Columns other
    than vec_id, label and embedding are ignored.
    """
    spark, path = vectors.sparkSession, work_dir(vectors.sparkSession)
    rows = staged(labelled(vectors), f"{path}/rows")
    n, own = rows.count(), rows.where(F.col("vec_id") % every == 0)
    own = staged(own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*"), f"{path}/anchors")
    tiles, groups = max(1, -(-n // CANDIDATES)), max(1, -(-own.count() // ANCHORS))
    candidates = _tiles(rows.withColumn("tile", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(tiles)).cast("int")), f"{path}/candidates")
    anchors = _tiles(own.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), f"{path}/asks")
    asks = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    heap = "anchor_id long, slot int, vec_id long, score long"

    def alike(r, scores, same, other_row):
        yield 0, same & other_row

    found = _heaps(_paired(asks, candidates, groups, tiles), positives, alike, heap)
    found = staged(found.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), f"{path}/positives")

    def windows(pdf):
        import pandas as pd

        return pd.DataFrame([(pdf["a_tile"].iloc[0], pdf[["anchor_id", "slot", "positive_score"]].to_numpy("int64").tobytes())], columns=["a_tile", "windows"])

    # three numbers for each positive of a tile's anchors
    bounds = found.select(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("a_tile"), "anchor_id", "slot", "positive_score").groupBy("a_tile").applyInPandas(windows, "a_tile int, windows binary")
    asks = staged(asks.join(bounds, "a_tile"), f"{path}/windows", 8)

    def between(r, scores, same, other_row):
        import numpy as np

        own = np.frombuffer(r.a_ids, "<i8")
        told = np.frombuffer(r.windows, "int64").reshape(-1, 3)
        for slot in np.unique(told[:, 1]).tolist():
            mine = told[told[:, 1] == slot]
            at = np.searchsorted(own, mine[:, 0])
            least, most = np.full(len(own), 1), np.full(len(own), 0)
            limit = (1 << 63) - 1
            for k, score in zip(at.tolist(), mine[:, 2].tolist(), strict=True):
                least[k], most[k] = max(-(-low * score // 100), -limit), min(high * score // 100, limit)
            yield int(slot), ~same & other_row & (scores >= least[:, None]) & (scores <= most[:, None])

    hard = _heaps(_paired(asks, candidates, groups, tiles), negatives, between, heap)
    out = hard.join(found, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    for name in ("rows", "anchors", "asks"):
        discard(spark, f"{path}/{name}")
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for every fiftieth embedding, from all of them."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
