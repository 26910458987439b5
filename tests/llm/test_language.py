import math
import zlib
from itertools import combinations

import numpy as np
import pytest

from convlake.llm.hashed import BITS
from convlake.llm.language import SLOPE, decide, family, identify, machine, op9_language_id, sampled, train

from .data import SF, awkward, clashing, table


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def test_machine_separates():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 5)).astype("float32")
    sign = np.where(x[:, 0] - 2 * x[:, 3] > 0, 1, -1)
    w = machine([(np.arange(5), v.astype("float64")) for v in x], sign, 5, c=100, passes=200)
    assert ((x @ w[:-1] + w[-1]) * sign > 0).mean() > 0.97


def test_hierarchy(spark):
    r = np.random.default_rng(2)
    centres = {"en": [4, 0, 1], "de": [4, 1, 0], "fr": [0, 4, 1], "it": [0, 4, -1], "xx": [-4, -4, 0]}
    labels = [k for k in centres for _ in range(30)]
    x = (np.array([centres[k] for k in labels]) + r.normal(scale=0.2, size=(150, 3))).astype("float32")
    model = train(spark, [{"label": k, "ids": np.arange(3, dtype="<i4").tobytes(), "v": v.tobytes()} for k, v in zip(labels, x, strict=True)], 3)
    assert {d[0] for d in model.duels} == {"", "germanic", "romance"}
    for lang, c in centres.items():
        got, score = decide(model, np.array([*c, 1]) @ model.weights)
        assert got == lang and 0 < score <= 1


def test_awkward(spark):
    rows = identify(clashing(table(spark))).collect()
    assert len(rows) == len(awkward())
    blank = {d for d, t, *_ in awkward() if not any(c.isalpha() for c in t or "")}
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in blank)
            assert r.lang_pred in ("und", "en", "fr", "de")
    assert identify(table(spark, [])).count() == 0
    assert [r.lang_pred for r in identify(table(spark, [(1, "abc", None, "s", 1)])).collect()] == ["und"]


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    rows = [r for r in op9_language_id(spark, SF.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_all_languages_are_learned(spark):
    rows = [(10 * k + i, f"text {i}", f"l{k:03}") for k in range(230) for i in range(3)] + [(5000, "again and again", "l000")] * 9000 + [(5001 + i, f"t{i}", "l001") for i in range(3000)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [tuple(r) for r in sampled(known, 2400).select("doc_id", "text", "lang").collect()]
    assert len(found) == len(set(found)) and {lang for *_, lang in found} == {f"l{k:03}" for k in range(230)}
    assert set(found) == {tuple(r) for r in sampled(known.repartition(7), 2400).select("doc_id", "text", "lang").collect()}
    assert max(sum(r[2] == lang for r in found) for lang in ("l000", "l001")) == 2400 // 230


def plain_features(text):
    """Mean of the runs of two and three letters, one by one."""
    codes = [" "]
    for c in text.lower():
        if c.isalpha():
            codes.append(c)
        elif codes[-1] != " " or len(codes) == 1:
            codes.append(" ")
    codes.append(" ")
    found = []
    for n in (2, 3):
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 32
            found.append((h >> 8) % 2**BITS)
    out = {}
    for k in found:
        out[k] = out.get(k, 0) + 100 / len(found)
    return out


def test_by_definition(spark):
    """All rows, by machines fitted one after the other and duels that are counted one by one."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = [(r.text, r.lang) for r in sampled(docs.where("lang is not null and text is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), 60).collect()]
    rows = {"": [(plain_features(t), family(lang), lang) for t, lang in known]}
    langs = sorted({lang for _, lang in known})

    def fitted(examples, a, b):
        own = [(x, 1 if name == a else -1) for x, name in examples if name in (a, b)]
        x = [(np.array(sorted(f)), np.array([np.float32(f[k]) for k in sorted(f)], "float64")) for f, _ in own]
        return machine(x, [s for _, s in own], 2**BITS)

    kin = sorted({family(lang) for lang in langs})
    duels = {(a, b): fitted([(x, f) for x, f, _ in rows[""]], a, b) for a, b in combinations(kin, 2)}
    for f in kin:
        duels |= {(a, b): fitted([(x, lang) for x, _, lang in rows[""]], a, b) for a, b in combinations([k for k in langs if family(k) == f], 2)}

    def winner(x, names):
        won, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = duels[a, b]
            m = sum(v * w[k] for k, v in x.items()) + w[-1]
            won[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                total[name] += own
                least[name] = min(least[name], 1 / (1 + math.exp(-SLOPE * own)))
        best = max(names, key=lambda k: (won[k], total[k]))
        return best, least[best]

    got = {r.doc_id: r for r in identify(docs, 60).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        x = plain_features(r.text)
        f, sure = winner(x, kin)
        lang, sure_too = winner(x, [k for k in langs if family(k) == f])
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(sure * sure_too, abs=1e-4)
