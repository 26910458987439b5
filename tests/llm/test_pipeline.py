"""Each stage of the pipeline against a plain version of itself, on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from convlake.llm.toxicity import score_toxicity

from .data import SF, awkward, table
from .test_exact_dedup import plain_normal
from .test_jaccard import plain as plain_components
from .test_mixing import plain_targets, words
from .test_packing import check as check_packing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages, at = docs.columns, dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mix_sources", "best_fit_packing"]
    for name, stage in stages.items():
        at[name] = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
    rows = {name: [tuple(r) for r in df.select("doc_id", "text", "source").collect()] for name, df in at.items()}

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in score_toxicity(at["toxicity"], labels).collect() if r.toxic_score < 0.5}
    assert {d for d, *_ in rows["exact_dedup"]} == kept and len(kept) < len(rows["toxicity"])

    best = {}
    for d, t, _ in rows["exact_dedup"]:
        best[plain_normal(t)] = max(best.get(plain_normal(t), -1), d)
    assert sorted(d for d, *_ in rows["jaccard_join"]) == sorted(best.values())

    found = plain_components([(d, t) for d, t, _ in rows["jaccard_join"]])
    assert sorted(d for d, *_ in rows["mix_sources"]) == sorted({c for _, _, c in found})

    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows["mix_sources"]:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    for _, t, s in rows["best_fit_packing"]:
        taken[s] += words(t)
    for s, want in plain_targets(sizes).items():
        assert abs(taken[s] - want) <= longest[s] / 2 + 1
    assert max(Counter(d for d, *_ in rows["best_fit_packing"]).values()) <= 2

    packed = docs.collect()
    repeats = [(d, t) for d, t, _ in rows["best_fit_packing"]]
    check_packing(packed, repeats, 2048)


def test_awkward_rows_go_through(spark, tmp_path):
    docs = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < docs.count() <= 20 * len(awkward())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
