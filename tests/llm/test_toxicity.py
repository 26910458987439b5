import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convlake.llm.toxicity import Ratio, count, op4_toxicity, score_toxicity, tokens, without_toxic

from .data import SF, awkward, clashing, table

LABELS = "doc_id long, quality int, toxic int"


def test_tokens():
    assert tokens("You, IDIOT!! é-x") == [b"you", b"idiot", "é".encode(), b"x"]


def test_models_are_distributions(spark):
    texts = [("a b a b c", 1), ("a b a d d d", 1), ("b c b c", 0), ("a c a c c", 0), ("d a", 0)]
    counts = count(spark.createDataFrame(texts, "text string, toxic int"))
    pairs = [Counter(), Counter()]
    for t, c in texts:
        w = tokens(t)
        pairs[c].update(zip([b"<s>", *w], w, strict=False))
    for c in (0, 1):
        assert counts.kinds[c] == len(pairs[c])
    for discount in (0.75, 1.0, 2.0):
        ratio = Ratio(counts, discount)
        for c, cut in enumerate(ratio.discounts):
            assert ratio.lower[c].sum() == pytest.approx(1)
            for first, k in counts.words.items():
                total = sum(n for (a, _), n in pairs[c].items() if a == first)
                over = sum(max(n - cut, 0) for (a, _), n in pairs[c].items() if a == first and n > 1)
                assert ratio.left[c][k] == pytest.approx(1 - over / total if total else 1)
    assert math.isfinite(Ratio(counts, 1.0).evidence("never seen words", (1,))[0])


def test_awkward(spark):
    labels = spark.createDataFrame([(d, 1, int(d % 3 == 0)) for d, *_ in awkward() if d is not None] + [(None, 1, 1), (11, 1, None), (9999, 0, 1)], LABELS)
    docs = clashing(table(spark))
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.toxic_score <= 1 for r in rows)
    assert without_toxic(docs, labels).columns == docs.columns
    assert score_toxicity(table(spark, []), labels).count() == 0
    assert {r.toxic_score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_both_labels_and_clashing_columns(spark):
    """Equal texts of both labels count as toxic, whichever row comes first; a column toxic_score stays."""
    texts = ["you vile fool", "a calm and sunny day", "you fool", "the day is calm"] * 30
    docs = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(texts)], "doc_id long, text string, toxic_score double")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0 and i % 3 > 0)) for i in range(len(texts))], LABELS)
    a = {(r.doc_id, r.toxic_score) for r in score_toxicity(docs, labels).collect()}
    assert a == {(r.doc_id, r.toxic_score) for r in score_toxicity(docs.orderBy(F.desc("doc_id")), labels.repartition(3)).collect()}
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and all(r.toxic_score == float(r.doc_id) for r in kept.collect())


def plain_ratio(counts_of, text, cut_of, order):
    """Sum of log ratios of a text by the definition, from counters of bigrams by class."""
    kinds = [len(c) for c in counts_of]
    before = [Counter(b for _, b in c) for c in counts_of]
    total = sum(kinds) + 1  # one for the words outside, of which there are none here
    out, w = 0.0, tokens(text)
    for a, b in zip([b"<s>", *w], w, strict=False):
        logs = []
        for c in (0, 1):
            own = sum(max(n - cut_of[c], 0) for n in before[c].values()) / kinds[c]
            shared = (before[0][b] + before[1][b]) / total
            p = max(before[c][b] - cut_of[c], 0) / kinds[c] + (1 - own) * shared
            after = sum(n for (x, _), n in counts_of[c].items() if x == a and counts_of[c])
            if order == 2 and after and any(n > 1 for (x, _), n in counts_of[c].items() if x == a):
                over = sum(max(n - cut_of[c], 0) for (x, _), n in counts_of[c].items() if x == a and n > 1)
                n = counts_of[c][(a, b)]
                p = (max(n - cut_of[c], 0) / after if n > 1 else 0) + (1 - over / after) * p
            logs.append(math.log(p))
        out += logs[1] - logs[0]
    return out


def test_ratio_by_definition(spark):
    texts = [("a b a b c", 1), ("a b a d d d", 1), ("b c b c a", 0), ("a c a c c d", 0), ("d a b b", 0)]
    counts = count(spark.createDataFrame(texts, "text string, toxic int"))
    pairs = [Counter(), Counter()]
    for t, c in texts:
        w = tokens(t)
        pairs[c].update(zip([b"<s>", *w], w, strict=False))
    for discount in (0.75, 1.0):
        for order in (1, 2):
            ratio = Ratio(counts, discount, order)
            for text in ("a b c d", "d d a c b a", "c a"):
                assert ratio.words(tokens(text)).sum() == pytest.approx(plain_ratio(pairs, text, ratio.discounts, order))


def test_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(marks[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in marks]
    toxic, clean = [x for x in seen if x[0]], [x for x in seen if not x[0]]
    assert sum(x[1] for x in toxic) > 0.7 * len(toxic)
    assert sum(x[1] for x in clean) < 0.02 * len(clean)
