"""Op 7. Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, longest first, and written as blocks of bounded
size; the stated queries are written as blocks too. A first pass over one block of long vectors gives
each query a score that its k-th result can't be below. Against a bucket that score is a threshold on
the cosine: above 1 the bucket is skipped, when it is high, the query's largest coordinates bound those
of a candidate, otherwise only lengths are compared. What is left is verified by its inner product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, work_dir

K = 20
BLOCK = 4096
QUERY_BLOCK = 512
BUCKETS = 512
#: From this local cosine threshold on, coordinates are compared.
COORDINATE_FROM = 0.6
FOCUS = 4

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

BLOCKS = "block int, longest double, n int, dim int, ids binary, data binary"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v and length of the rows that take part: floor(scale * x) of every component.

    Rows with a null id, a null vector, or a null or non-finite component take no part; rows that repeat
    an id and a vector count once.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable).select("vec_id", v.alias("v")).distinct()
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _pack(block, ids, rows):
    """One row of BLOCKS, sorted by length, longest first; shorter vectors end in zeros."""
    import numpy as np

    dim = max((len(r) for r in rows), default=0)
    m = np.zeros((len(rows), dim), dtype="<i8")
    for k, r in enumerate(rows):
        m[k, : len(r)] = r
    length = np.sqrt((m.astype("float64") ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    m, ids = m[order], np.asarray(ids, "<i8")[order]
    small = m.size == 0 or np.abs(m).max() < 1 << 15
    return block, float(length.max(initial=0)), len(ids), dim, ids.tobytes(), m.astype("<i2" if small else "<i8").tobytes()


def _unpack(n: int, dim: int, ids: bytes, data: bytes):
    import numpy as np

    kind = "<i2" if len(data) == 2 * n * dim else "<i8"
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(n, dim).astype("float64")


def _blocks(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (vec_id, v, block) as one row of BLOCKS per block."""

    def pack(pdf):
        import pandas as pd

        return pd.DataFrame([_pack(pdf["block"].iloc[0], pdf["vec_id"].to_numpy(), list(pdf["v"]))], columns=["block", "longest", "n", "dim", "ids", "data"])

    return staged(rows.groupBy("block").applyInPandas(pack, BLOCKS), path)


def search(q_ids, q, floors, ids, v, k: int):
    """The k best of ``v`` (longest first) for each query that can still have results there.

    ``floors`` has what a result must reach. Returns rows (query, vector, score) as three arrays.
    """
    import numpy as np

    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    q_len, v_len = np.sqrt((q**2).sum(axis=1)), np.sqrt((v**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_len > 0, floors / q_len, np.where(floors > 0, np.inf, -np.inf)) * (1 - np.sign(floors) * 1e-9)
    top = v_len[0] if len(v_len) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(need > 0, need / top, -1.0)
    unit = v / np.where(v_len > 0, v_len, 1)[:, None]
    found: list[tuple] = []

    def best(at: int, rows, scores) -> None:
        ok = (ids[rows] != q_ids[at]) & (scores >= floors[at])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = np.lexsort((ids[rows], -scores))[:k]
        found.append((np.full(len(order), q_ids[at]), ids[rows][order], scores[order]))

    by_length = np.flatnonzero(cosine < COORDINATE_FROM)
    if len(by_length):
        ends = np.searchsorted(-v_len, -np.maximum(need[by_length], 0), "right")
        scores = v[: ends.max()] @ q[by_length].T
        for k_, (at, end) in enumerate(zip(by_length, ends, strict=True)):
            best(at, np.arange(end), scores[:end, k_])
    for at in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1)):
        direction, t = q[at] / q_len[at], float(cosine[at])
        mask = v_len >= need[at]
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            # within the angle of t around the query, which can take in the axis itself
            middle, reach = direction[f] * t, np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - t * t))) + 1e-7
            if direction[f] < t:
                mask &= unit[:, f] <= middle + reach
            if direction[f] > -t:
                mask &= unit[:, f] >= middle - reach
        rows = np.flatnonzero(mask)
        best(at, rows, v[rows] @ q[at])
    return tuple(np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of every query.

    ``vectors`` and ``queries`` have vec_id and embedding. A query's own id is no candidate of it; where
    an id has several vectors, all are candidates and the smallest asks. Ties go to the smaller vec_id;
    of two vectors of different sizes the shorter ends in zeros. Sums are exact below 2 ** 53.
    """
    import numpy as np

    spark = vectors.sparkSession
    folder = work_dir(spark)
    rows = staged(quantised(vectors), f"{folder}/vectors")
    asked = staged(quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v")), f"{folder}/asked")

    n = rows.count()
    many = min(BUCKETS, -(-n // BLOCK))
    cuts = rows.agg(F.percentile_approx("length", [i / many for i in range(1, many)], 10_000).alias("c")).first()["c"] if many > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    bucket = F.lit(0)
    for c in cuts:  # how many cuts lie above
        bucket = bucket + (F.col("length") < c).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # BUCKETS at most
    first, parts = {}, {}
    for b in sorted(sizes):
        first[b], parts[b] = sum(parts.values()), -(-sizes[b] // BLOCK)
    table = spark.createDataFrame([(b, first[b], parts[b]) for b in first] or [(0, 0, 1)], "bucket int, first int, parts int")
    share = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    blocks = _blocks(rows.join(F.broadcast(table), "bucket").select("vec_id", "v", (F.col("first") + share).alias("block")), f"{folder}/blocks")

    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    asks = _blocks(asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("block")), f"{folder}/asks")
    asks = asks.select(*(F.col(c).alias(f"q_{c}") for c in asks.columns))

    def bound(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, q = _unpack(r.q_n, r.q_dim, r.q_ids, r.q_data)
                got, _, scores = search(q_ids, q, np.full(len(q_ids), -np.inf), *_unpack(r.n, r.dim, r.ids, r.data), k)
                low = pd.Series(scores).groupby(got).agg(["size", "min"])
                floors = low["min"].where(low["size"] >= k).reindex(q_ids).fillna(-np.inf).to_numpy()
                lengths = np.sqrt((q**2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((floors > 0) & (lengths > 0), floors / lengths, 0).min() if len(q_ids) else 0
                yield pd.DataFrame({"q_block": [r.q_block], "need": [need * (1 - 1e-9)], "floors": [floors.tobytes()]})

    paired = asks.withColumn("block", F.lit(0)).join(blocks, "block")
    floors = staged(paired.mapInPandas(bound, "q_block int, need double, floors binary"), f"{folder}/floors")

    def verify(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, q = _unpack(r.q_n, r.q_dim, r.q_ids, r.q_data)
                got = search(q_ids, q, np.frombuffer(r.floors), *_unpack(r.n, r.dim, r.ids, r.data), k)
                yield pd.DataFrame({c: x.astype("int64") for c, x in zip(("query_id", "vec_id", "score"), got, strict=True)})

    # blocks that can hold results of a block of queries, and only they, are sent to it
    pairs = blocks.select("block", "longest").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(floors, "q_block").where(F.col("longest") >= F.col("need"))
    full = pairs.select("block", "q_block", "floors").repartition("block", "q_block").join(blocks, "block").join(asks, "q_block")
    found = full.mapInPandas(verify, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
