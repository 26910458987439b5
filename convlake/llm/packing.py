"""Op 10. Best-fit packing of token sequences with large-item matching.

Items of one length are interchangeable, so the packing is decided on the histogram of lengths, which
has at most ``capacity`` rows whatever the size of the table. Items above a third of the capacity are
matched first: largest first, each with the largest other that still fits, so that as many sequences as
possible hold two. Smaller items then go, longest first, to the fullest sequence with room for them.
The decision is a list of runs (so many items of this length, k per sequence, from this sequence on);
Spark ranks the items of each length and looks each rank up in the runs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, work_dir
from .tokens import encoder

CAPACITY = 2048
#: A length's items are ranked in so many parts, so that a common length isn't one task's work.
SALTS = 64
SLICE = 64
#: Words that a worker remembers.
MEMO_WORDS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """Ranks ``low`` to ``high`` - 1 of ``length`` lie ``per`` to a sequence from ``sequence`` on, at ``offset``."""

    length: int
    low: int
    high: int
    per: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that pack ``counts`` (items by length, 1 to ``capacity``)."""
    left, used, runs = {k: n for k, n in counts.items() if n}, defaultdict(int), []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    sizes: list[int] = []  # of rooms, ascending
    opened = 0

    def put(length: int, n: int, per: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, used[length], used[length] + n, per, sequence, offset))
        used[length] += n
        left[length] -= n

    def room(size: int, sequence: int, many: int) -> None:
        if size and many:
            if not rooms[size]:
                insort(sizes, size)
            rooms[size].append((sequence, many))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        length = large[-1]
        at = bisect_left(large, capacity - length + 1) - 1
        if at == len(large) - 1 and left[length] < 2:
            at -= 1
        if at < 0:
            many = left[length]
            put(length, many, 1, opened, 0)
            room(capacity - length, opened, many)
        elif large[at] == length:
            many = left[length] // 2
            put(length, 2 * many, 2, opened, 0)
            room(capacity - 2 * length, opened, many)
        else:
            many, other = min(left[length], left[large[at]]), large[at]
            put(length, many, 1, opened, 0)
            put(other, many, 1, opened, length)
            room(capacity - length - other, opened, many)
        opened += many
        large = [k for k in large if left[k]]

    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                per = capacity // length
                many = -(-left[length] // per)
                room(capacity, opened, many)
                opened += many
                continue
            size = sizes[at]
            sequence, many = rooms[size].pop()
            if not rooms[size]:
                sizes.pop(at)
            per = size // length
            full = min(many, left[length] // per)
            if not full:
                per, full = left[length], 1
            put(length, full * per, per, sequence, capacity - size)
            room(size - per * length, sequence, full)
            room(size, sequence + full, many - full)
    return runs


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row's whole ``text`` (null: empty): all but the last are ``capacity`` long."""

    def pieces(batches):
        import numpy as np
        import pandas as pd

        enc, end = encoder(tokenizer_path, "drop", MEMO_WORDS), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            texts = ["" if t is None else t for t in pdf["text"]]
            for i in range(0, len(texts), SLICE):
                rows = []
                for doc_id, raw in zip(ids[i : i + SLICE], enc.encode(texts[i : i + SLICE]), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (PIECES, of lengths 1 to ``capacity``) with sequence_id and offset.

    Every piece is placed once; a sequence's pieces lie gapless from 0 and take at most ``capacity``.
    Which of several pieces of a length takes a place follows a hash of its id, so reruns agree; rows
    that repeat are placed as often as they come. ``pieces`` is read twice: give a written table.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn("tie", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int"))
    cells = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity * SALTS rows
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity
    # as many rows as the plan has runs, which depends on the capacity and not on the table
    runs = spark.createDataFrame(plan(counts, capacity), "length long, low long, high long, per long, sequence long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("tie", "doc_id", "piece"))
    ranked = keyed.withColumn("nth", nth).join(F.broadcast(firsts), ["length", "salt"]).select(*pieces.columns, (F.col("first") + F.col("nth") - 1).alias("rank"))
    within = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*(ranked[c] for c in pieces.columns), (F.col("sequence") + F.floor(within / F.col("per"))).alias("sequence_id"), (F.col("at") + within % F.col("per") * ranked["length"]).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Cut every document and pack the pieces; the pieces are written once to a work table.

    A null or empty text is a piece of one token, its end. A null id is kept, rows that repeat are packed as
    often as they come, and other columns are ignored. An empty table gives no pieces.
    """
    pieces = staged(cut(docs, tokenizer_path, end_id, capacity), f"{work_dir(docs.sparkSession)}/pieces")
    return pack(pieces, capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
