import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from convlake.llm.mixing import fit_budget, mix, mixed_documents, op1_mix_sources

from .data import SF, awkward, clashing, table


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deal, cut, deal again, until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > most * sizes[s]]
        if not over:
            return full | {s: w[s] * level for s in rest}
        full |= {s: most * sizes[s] for s in over}


def words(text):
    return len((text or "").encode().split())


def check(rows, docs):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, _, source, *_ in docs:
        sizes[source] += words(text)
        longest[source] = max(longest[source], words(text))
    want, taken = plain_targets(sizes), defaultdict(int)
    by_id = defaultdict(list)
    for d, text, _, source, *_ in docs:
        by_id[d, words(text)].append(source)
    for r in rows:
        source = by_id[r.doc_id, r.size].pop() if "source" not in r.asDict() else r.source
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, x in taken.items():
        assert abs(want[source] - x) <= longest[source] / 2 + 1, (source, x, want[source])


def test_fit_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        lengths = np.array(r.sample(range(1, 40), r.randint(1, 7)))
        counts = np.array([r.randint(1, 5) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()))
        take = fit_budget(lengths, counts, budget, span=50)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        got, best = int((take * lengths).sum()), min(abs(s - budget) for s in sums)
        assert abs(got - budget) <= best + 12
    lengths = np.arange(1, 3000)
    take = fit_budget(lengths, np.full(2999, 7), 10_000_019)
    assert int((take * lengths).sum()) == 10_000_019


def test_awkward(spark):
    rows = mix(clashing(table(spark))).collect()
    assert len(rows) == len(awkward())
    check(rows, awkward())
    assert Counter((r.doc_id, r.taken) for r in mix(table(spark)).collect()) == Counter((r.doc_id, r.taken) for r in rows)


def test_empty(spark):
    assert mix(table(spark, [])).count() == 0
    blank = mix(table(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 1)])).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_documents(spark):
    docs = clashing(table(spark))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    by_id = Counter(r.doc_id for r in out.collect())
    for r in mix(docs).collect():
        if r.doc_id not in (5, None):
            assert by_id[r.doc_id] == r.copies


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op1_mix_sources(spark, SF).collect(), docs)


def test_copies_of_rows_alike(spark):
    """Rows without an id, of one source and size, are in the mix as often as it says, and no more."""
    docs = table(spark, [(None, f"one two three{i}", "en", "abc"[i % 3], 1) for i in range(90)] + [(7, f"four five{i}", "en", "b", 1) for i in range(5)])
    want = Counter()
    for x in mix(docs).collect():
        want[x.doc_id, x.source] += x.copies
    rows = mixed_documents(docs).collect()
    assert Counter((x.doc_id, x.source) for x in rows) == +want
    least = {k: min(x.copies for x in mix(docs).collect() if (x.doc_id, x.source) == k) for k in want}
    assert all(n - least[x[0], x[1]] in (0, 1) for x, n in Counter((x.doc_id, x.source, x.text) for x in rows).items())
