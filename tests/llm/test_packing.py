import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P

from convlake.llm.packing import op10_best_fit_packing, pack_documents, plan
from convlake.llm.tokens import load_tokenizer

from .data import SF, awkward, clashing, table

PATH = P.path("word_bpe_49k.json")


def placed(runs):
    """Items by sequence, one by one."""
    out = defaultdict(list)
    for r in runs:
        for rank in range(r.low, r.high):
            k, nth = divmod(rank - r.low, r.per)
            out[r.sequence + k].append((r.offset + nth * r.length, r.length))
    return out


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_against_items_one_by_one():
    r = random.Random(3)
    for capacity in (10, 60, 300):
        for _ in range(20):
            items = [r.randint(1, capacity) for _ in range(r.randint(0, 200))]
            runs = plan(Counter(items), capacity)
            found = placed(runs)
            assert Counter(n for x in found.values() for _, n in x) == Counter(items)
            for x in found.values():
                at = 0
                for offset, n in sorted(x):
                    assert offset == at
                    at += n
                assert at <= capacity
            assert sorted(found) == list(range(len(found)))
            assert len(found) <= 1.1 * plain_best_fit(items, capacity) + 1
            large = Counter(k for k, x in found.items() for _, n in x if 3 * n > capacity)
            assert max(large.values(), default=0) <= 2


def check(rows, docs, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array(load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc_id].append((k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    least = sum(n for x in sequences.values() for _, n in x) / capacity
    assert len(sequences) <= 1.15 * least + 2


def test_awkward(spark):
    rows = pack_documents(clashing(table(spark)), PATH, capacity=256).collect()
    check(rows, [(d, t) for d, t, *_ in awkward()], 256)


def test_empty(spark):
    assert pack_documents(table(spark, []), PATH).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op10_best_fit_packing(spark, SF).collect(), docs, 2048)
