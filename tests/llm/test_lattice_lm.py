import math
import zlib
from collections import Counter

import public_tokenizers as P
import pytest

from convlake.llm.lattice_lm import Lattice, first_scores, fit, op3_lattice_score, score_texts, vocabulary

from .data import SF, awkward, clashing, table

PATH = P.path("piece_bpe_32k.model")


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def every_segmentation(text, lattice):
    """Probabilities of all ways to cut ``text``."""
    if not text:
        return [1.0]
    out = [] if text[0] in lattice.pieces else [math.exp(lattice.spell(text[0])[1]) * p for p in every_segmentation(text[1:], lattice)]
    for n in range(1, len(text) + 1):
        if text[:n] in lattice.pieces:
            out += [math.exp(lattice.pieces[text[:n]][1]) * p for p in every_segmentation(text[n:], lattice)]
    return out


def test_forward_sums_all_segmentations():
    lattice = Lattice(PATH, first_scores(PATH))
    for word in ("the", "tion", "ñandú", "a", "x1\U0001f600", "thhe"):
        assert lattice.forward(word) == pytest.approx(math.log(sum(every_segmentation("▁" + word, lattice))))


def test_expected_pieces_cover_the_word():
    lattice = Lattice(PATH, first_scores(PATH))
    counts = [0.0] * len(lattice.scores)
    lattice.expect("thet", 3, counts)
    width = {k: len(p) for p, k in vocabulary(PATH)[0].items()}
    in_bytes = {k for k in lattice.in_bytes}
    spelled = sum(c for k, c in enumerate(counts) if k in in_bytes)
    mark = len("▁".encode())
    whole = sum(c * width.get(k, 0) for k, c in enumerate(counts) if k not in in_bytes)
    assert 15 - 1e-9 <= whole + spelled <= 15 + 3 * (mark - 1)


def test_rounds_raise_the_likelihood(spark):
    words = spark.createDataFrame([(bytearray(w.encode()), c, c) for w, c in (("the", 50), ("thetion", 7), ("stst", 4), ("é", 2))], "word binary, c long, n long")
    likely = []
    for rounds in (0, 1, 2, 3):
        lattice = Lattice(PATH, fit(words, 0, PATH, rounds, prior=1e-6))
        likely.append(sum(r.c * lattice.forward(bytes(r.word).decode()) for r in words.collect()))
    assert likely == sorted(likely) and likely[1] > likely[0] + 1


def check(rows, docs):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for d, t in docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=2e-3)
    assert {r.train_tokens for r in rows} == {n}


@pytest.mark.parametrize("hot", [0, 4, 1000])
def test_awkward(spark, hot):
    rows = score_texts(clashing(table(spark)), PATH, rounds=1, hot_words=hot).collect()
    check(rows, [(d, t) for d, t, *_ in awkward()])
    test_awkward.scores.append(sorted(round(r.score, 5) for r in rows))
    assert test_awkward.scores[0] == pytest.approx(test_awkward.scores[-1], abs=1e-3)


test_awkward.scores = []


def test_empty(spark):
    assert score_texts(table(spark, []), PATH).count() == 0


def test_query(spark):
    rows = op3_lattice_score(spark, SF).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert all(r.score < 0 for r in rows)


def plain_round(words, scores, prior, ends):
    """One round of expectation-maximisation, by listing every segmentation of every word."""
    lattice = Lattice(PATH, scores)
    counts = dict.fromkeys({*vocabulary(PATH)[0].values(), *lattice.in_bytes, lattice.end}, prior)
    counts[lattice.end] += ends

    def cuts(text):
        if not text:
            return [(1.0, ())]
        out = [] if text[0] in lattice.pieces else [(math.exp(lattice.spell(text[0])[1]) * p, (*lattice.spell(text[0])[0], *ids)) for p, ids in cuts(text[1:])]
        for n in range(1, len(text) + 1):
            if text[:n] in lattice.pieces:
                k, score = lattice.pieces[text[:n]]
                out += [(math.exp(score) * p, (k, *ids)) for p, ids in cuts(text[n:])]
        return out

    for word, c in words:
        ways = cuts("▁" + word)
        whole = sum(p for p, _ in ways)
        for p, ids in ways:
            for k in ids:
                counts[k] += c * p / whole
    total = sum(counts.values())
    return {k: math.log(c / total) for k, c in counts.items()}


def test_fit_by_definition(spark):
    """Words laid out in rows give the scores that listing all segmentations gives."""
    import numpy as np

    words = [("the", 50), ("thetion", 7), ("stst", 4), ("é", 2), ("x\U0001f600y", 3), ("\U0001f600\U0001f601", 1), ("a", 9)]
    table_ = spark.createDataFrame([(bytearray(w.encode()), c, c) for w, c in words], "word binary, c long, n long")
    want = first_scores(PATH)
    for _ in range(2):
        found = plain_round(words, want, 0.1, 5)
        want = np.array([found.get(k, -np.inf) for k in range(len(want))])
    got = fit(table_, 5, PATH, 2)
    assert got == pytest.approx(want, abs=1e-9)


def test_rows_of_lattices_are_the_lattices_of_their_words(spark, monkeypatch):
    """Small rows, words with count 0 and words beyond LONG change nothing."""
    import random

    from convlake.llm import lattice_lm

    r = random.Random(8)
    words = sorted({"".join(r.choice("thesionaréß\U0001f600") for _ in range(r.randint(1, 90))) for _ in range(300)})
    table_ = spark.createDataFrame([(bytearray(w.encode()), k % 4, k) for k, w in enumerate(words)], "word binary, c long, n long")
    seen = []
    for chunk, long in ((4096, 64), (7, 64), (50, 10), (50, 1000)):
        monkeypatch.setattr(lattice_lm, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(lattice_lm, "LONG", long)
        laid = lattice_lm.lattices(table_, PATH).cache()
        assert sorted(bytes(w).decode() for row in laid.collect() for w in row.words) == words
        scores, likely = lattice_lm.fit_lattices(laid, 3, PATH, 3)
        assert likely == sorted(likely)
        seen.append(scores)
        lattice = Lattice(PATH, scores)
        for row in laid.toPandas().itertuples():
            if row.sizes is not None:
                assert lattice_lm.Lattices(row, lattice).forward() == pytest.approx([lattice.forward(bytes(w).decode()) for w in row.words])
    for scores in seen[1:]:
        assert scores == pytest.approx(seen[0], abs=1e-9)
