import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from convlake.llm import exact_dedup
from convlake.llm.exact_dedup import deduplicated, directory, exact_groups, in_buckets, normal, op2_exact_dedup

from .data import SF, awkward, clashing, table


def plain_normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[plain_normal(t)].append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        ids = by_sha[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and (r.keep_id, r.group_size) == (keep, len(ids))
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == keep
    assert dict(kept) == dict.fromkeys(by_sha, 1)


def test_awkward(spark):
    check(exact_groups(clashing(table(spark)), capacity=2).collect(), [(d, t) for d, t, *_ in awkward()])
    assert exact_groups(table(spark, [])).count() == 0


def test_normal(spark):
    texts = ["ABC", "ÉA", "Ⓐ İ ΑΣ Σ", "ǅ A", "ß A", "ᲐA", "plain é A", "Ⅷ A", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", normal(F.col("text")).alias("t")).collect()
    assert all(r.t == plain_normal(r.text) for r in rows)


def test_directory_splits_overfull_buckets(spark, tmp_path):
    for k, keys in enumerate((spark.range(3000).select(F.xxhash64("id").alias("h")), spark.range(2000).select((F.col("id") * 5).alias("h")))):  # the second one agrees in 50 bits
        levels = directory(keys, str(tmp_path / str(k)), capacity=100, start=1)
        assert (len(levels) > 1) == (k == 1)
        load, depth = defaultdict(int), {}
        for r in in_buckets(keys, levels).collect():
            h, bucket = r.h % 2**64, r.bucket % 2**64
            assert h >> (64 - r.depth) == bucket >> (64 - r.depth) and bucket % (1 << (64 - r.depth)) == 0
            load[bucket] += 1
            depth[bucket] = r.depth
        assert max(load.values()) <= 100 and sum(load.values()) == keys.count()
        for bucket, d in depth.items():
            if d > 1:  # its parent would have been overfull
                assert sum(n for b, n in load.items() if b >> (65 - d) == bucket >> (65 - d)) > 100


def test_chains_decide_by_bytes(spark, monkeypatch):
    """With a hash of three values nearly all texts collide, and lie in chains."""
    monkeypatch.setattr(exact_dedup, "text_hash", lambda t: F.pmod(F.length(t), F.lit(3)).cast("long"))
    check(exact_groups(table(spark), capacity=1).collect(), [(d, t) for d, t, *_ in awkward()])


def test_rows_are_found_by_the_directory(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, path, capacity: [(b, t.withColumn("slot", -1 - F.col("slot"))) for b, t in directory(keys, path, capacity)])
    assert exact_groups(table(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = clashing(table(spark))
    out = deduplicated(docs)
    assert out.columns == docs.columns
    best = {}
    for d, t, *_ in awkward():
        k = plain_normal(t)
        best[k] = max(best.get(k, -1), -1 if d is None else d)
    assert sorted((-1 if r.doc_id is None else r.doc_id, plain_normal(r.text)) for r in out.collect()) == sorted((d, k) for k, d in best.items())


def test_query(spark):
    check(op2_exact_dedup(spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
