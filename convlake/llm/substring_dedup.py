"""Op 12. Substring dedup: windows of words that come in an earlier document, by FM-indexes over shards.

Each window of ``width`` words has an anchor, the least hash of the runs of ``GRAM`` words in it, so equal
windows have equal anchors wherever they stand. Consecutive windows with one anchor make a segment. Anchors
that lie in one document alone are done with; the segments of the others are dealt to shards by anchor,
which brings all windows that can be equal together. In a shard the different segments make one compressed
FM-index, and every segment is then searched in it backwards: where ``width`` words match, the interval
says the least document that has the window. What is found comes back by segment, and a document loses the
words of windows that a smaller one has.

Documents with the same words are searched once. An anchor with more than ``HOT`` different segments is
taken apart into its windows, which are told apart before they are dealt out, so no shard gets more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_keys, keep_keys, staged, work_dir
from .fm_index import NONE, FMIndex

WIDTH = 50
GRAM = 8
#: Words of a shard, about; with an anchor's bound no shard is much larger.
SHARD_WORDS = 1 << 18
HOT = 4096
#: Windows that are looked at together; a place within them fits in the low bits of a hash.
CHUNK = 1 << 20
ROW_GROUP = 8 << 20
ROWS = 256

SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), f AS MATERIALIZED (
  SELECT x.doc_id, x.i FROM x JOIN (SELECT t, min(doc_id) AS least FROM x GROUP BY t) s ON s.t = x.t AND s.least < x.doc_id
), r AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM f CROSS JOIN range(50) o(k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda y, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def word_bounds(data: bytes):
    """Where the words of ``data`` (between single spaces) begin and end."""
    import numpy as np

    spaces = np.flatnonzero(np.frombuffer(data, "uint8") == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])


_POWERS: dict = {}


def powers(n: int):
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    import numpy as np

    if len(_POWERS.get("up", ())) < n:
        size, up = 1 << max(16, (n - 1).bit_length()), 0x9E3779B97F4A7C15
        for name, base in (("up", up), ("down", pow(up, -1, 1 << 64))):
            factors = np.full(size, base, "uint64")
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"]


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def segments(data: bytes, width: int = WIDTH, gram: int = GRAM):
    """First window, number of windows and anchor of every segment of ``data``, in order.

    Equal words have equal hashes; others may have, which only makes segments meet that don't match.
    """
    import numpy as np

    begin, end = word_bounds(data)
    none = np.zeros(0, "int64")
    if not data or len(begin) < width:
        return none, none, none
    gram = min(gram, width)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(np.frombuffer(data, "uint8") * up[: len(data)], dtype="uint64")])
    words = mixed((sums[end] - sums[begin]) * down[begin])
    places = np.uint64(2 * CHUNK - 1)
    firsts, numbers, anchors = [], [], []
    for low in range(0, len(begin) - width + 1, CHUNK):
        own = words[low : low + CHUNK + width - 1]
        h = np.zeros(len(own) - gram + 1, "uint64")
        for k in range(gram):
            h = h * np.uint64(0xD6E8FEB86659FD93) + own[k : len(own) - gram + 1 + k]
        h = mixed(h)
        # the least hash, and of equal ones the first, within width - gram + 1 places
        least, span, most = (h & ~places) | np.arange(len(h), dtype="uint64"), 1, width - gram + 1
        while span < most:
            step = min(span, most - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        at = (least & places).astype("int64")
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        firsts.append(first + low)
        numbers.append(np.diff(np.append(first, len(at))))
        anchors.append(h[at[first]].view("int64"))
    return tuple(map(np.concatenate, (firsts, numbers, anchors)))


def _read(docs: DataFrame, width: int, path: str) -> DataFrame:
    """rid, doc_id, ord, n_words, whole (SHA-256 of the words), text (the words, compressed) and the segments of every row."""

    def read(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [b" ".join((x or b"").split()) for x in batch.column("text").to_pylist()]
            found = [segments(x, width) for x in texts]
            columns = [
                batch.column("rid"), batch.column("doc_id"), pa.array([x.count(b" ") + 1 if x else 0 for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.array(map(press, texts), pa.binary()),
                *(pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_words", "whole", "text", "firsts", "numbers", "anchors"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(read, "rid long, doc_id long, n_words long, whole binary, text binary, firsts array<int>, numbers array<int>, anchors array<long>")
    return staged(found.withColumn("ord", F.coalesce("doc_id", F.lit(NONE))), path, ROWS, ROW_GROUP)


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """rid, lo, first, key and segment (the words) of the chosen segments of ``rows`` (rid, lo, text, chosen)."""

    def cut(batches):
        import pyarrow as pa
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rid, lo, first, key, out, size = [], [], [], [], [], 0
            for r, own, text, chosen in zip(*(batch.column(c).to_pylist() for c in ("rid", "lo", "text", "chosen")), strict=True):
                text = plain(text)
                begin, end = word_bounds(text)
                for c in chosen:
                    rid.append(r)
                    lo.append(own)
                    first.append(c["first"])
                    key.append(c["key"])
                    out.append(text[begin[c["first"]] : end[c["first"] + c["number"] + width - 2]])
                    size += len(out[-1])
                    if size > ROW_GROUP:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rid, lo, first, key, out), kinds, strict=True)], names)
                        rid, lo, first, key, out, size = [], [], [], [], [], 0
            if rid:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rid, lo, first, key, out), kinds, strict=True)], names)

    import pyarrow as pa

    kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), ["rid", "lo", "first", "key", "segment"]
    return rows.mapInArrow(cut, "rid long, lo long, first int, key long, segment binary")


def mark(segment: str = "segment"):
    """What stands for a segment in joins: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(segment, 256)), 1, 16)


def searched(parts: DataFrame, width: int) -> DataFrame:
    """mark, low, high and least for each run of windows of each of ``parts`` (key, mark, segment, least), different ones.

    ``least`` is the smallest label of all parts that have the window; parts of one key go to one shard.
    """
    words = F.length(F.regexp_replace(F.col("segment").cast("string"), "[^ ]+", "")).cast("long") + 1
    total = parts.agg(F.sum(words).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def search(pdf):
        import numpy as np
        import pandas as pd

        own = list(pdf["segment"])
        index = FMIndex(own, pdf["least"].to_numpy("int64"), width)
        found, first = index.windows(own)
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[first[:-1]] = True
        low = np.flatnonzero(new)
        owner = np.searchsorted(first, low, "right") - 1
        high = np.append(low[1:], len(found))
        return pd.DataFrame({"mark": pdf["mark"].to_numpy()[owner], "low": low - first[owner], "high": high - first[owner], "least": found[low]})

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "mark", "segment", "least")
    return dealt.groupBy("shard").applyInPandas(search, "mark binary, low int, high int, least long")


def _windows(parts: DataFrame, width: int) -> DataFrame:
    """Every window of ``parts``: the part's mark, its place, its words and the part's label."""

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for m, s, least in zip(*(batch.column(c).to_pylist() for c in ("mark", "segment", "least")), strict=True):
                begin, end = word_bounds(s)
                n = len(begin) - width + 1
                columns = [pa.array([m] * n, pa.binary()), pa.array(np.arange(n, dtype="int32")), pa.array([s[begin[i] : end[i + width - 1]] for i in range(n)], pa.binary()), pa.array([least] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "place", "segment", "least"])

    return parts.select("mark", "segment", "least").mapInArrow(windows, "mark binary, place int, segment binary, least long")


def matches(parts: DataFrame, width: int, path: str) -> DataFrame:
    """mark, low, high and least of ``parts`` (key, mark, segment, least: a row for each different segment)."""
    hot = staged(parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), f"{path}/hot")
    if hot.isEmpty():
        return searched(parts, width)
    windows = staged(_windows(keep_keys(parts, hot, "key"), width).withColumn("window", mark()), f"{path}/windows", ROWS, ROW_GROUP, "zstd")
    alone = windows.groupBy("window", "segment").agg(F.min("least").alias("least"))
    alone = staged(alone.select(F.xxhash64("window").alias("key"), F.col("window").alias("mark"), "segment", "least"), f"{path}/alone", ROWS, ROW_GROUP, "zstd")
    found = searched(alone, width).select(F.col("mark").alias("window"), "least")
    apart = windows.select("mark", "place", "window").join(found, "window").select("mark", F.col("place").alias("low"), (F.col("place") + 1).alias("high"), "least")
    return searched(drop_keys(parts, hot, "key"), width).unionByName(apart)


def _kept(rows: DataFrame, width: int) -> DataFrame:
    """rid, n_removed and kept_sha256 of ``rows`` (rid, text, spans of windows)."""

    def keep(batches):
        import hashlib

        import numpy as np
        import pandas as pd
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            n, sums = [], []
            for text, spans in zip(map(plain, pdf["text"]), pdf["spans"], strict=True):
                begin, end = word_bounds(text)
                change = np.zeros(len(begin) + 1, "int64")
                for s in spans:
                    change[s["low"]] += 1
                    change[s["high"] + width - 1] -= 1
                kept = np.cumsum(change[:-1]) == 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype("int8"), [0]])))
                n.append(int((~kept).sum()))
                sums.append(hashlib.sha256(b" ".join(text[begin[a] : end[b - 1]] for a, b in zip(edge[::2], edge[1::2], strict=True))).hexdigest())
            yield pd.DataFrame({"rid": pdf["rid"], "n_removed": n, "kept_sha256": sums})

    return rows.mapInPandas(keep, "rid long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    Null and empty texts have no words. A null doc_id is above all others, and rows of one id are never
    smaller than one another, so repeated rows lose nothing to each other. A text shorter than ``width``
    words has no window and stays whole. Columns other than doc_id and text are ignored.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    rows = _read(docs, width, f"{path}/rows")
    # one row for each sequence of words: the smallest document that has it, and the largest
    texts = staged(rows.where(F.col("n_words") >= width).groupBy("whole").agg(F.min(F.struct("ord", "rid")).alias("m"), F.max("ord").alias("hi")).select("whole", F.col("m.rid").alias("rid"), F.col("m.ord").alias("lo"), "hi"), f"{path}/texts")
    # joined before it is exploded: one row for each text is sent, not one for each segment
    listed = rows.select("rid", "firsts", "numbers", "anchors").join(texts.select("rid", "lo", "hi"), "rid")
    keys = listed.select("lo", "hi", F.explode("anchors").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key"), f"{path}/shared")
    own = listed.select("rid", F.explode(F.arrays_zip("firsts", "numbers", "anchors")).alias("s")).select("rid", F.col("s.firsts").alias("first"), F.col("s.numbers").alias("number"), F.col("s.anchors").alias("key"))
    chosen = own.join(shared, "key").groupBy("rid").agg(F.collect_list(F.struct("first", "number", "key")).alias("chosen")).join(texts.select("rid", "lo"), "rid")
    cut = _cut(rows.select("rid", "text").join(chosen, "rid"), width)
    cut = staged(cut.withColumn("mark", mark()), f"{path}/segments", ROWS, ROW_GROUP, "zstd")
    # Spark compares the words themselves, first within each task
    parts = staged(cut.groupBy("key", "mark", "segment").agg(F.min("lo").alias("least")), f"{path}/parts", ROWS, ROW_GROUP, "zstd")
    found = staged(matches(parts, width, path), f"{path}/found")
    spans = cut.select("rid", "lo", "first", "mark").join(found, "mark").where(F.col("least") < F.col("lo"))
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("spans"))
    lost = staged(_kept(rows.select("rid", "text").join(spans, "rid"), width), f"{path}/lost", ROWS)
    for name in ("shared", "segments", "parts", "found"):
        discard(spark, f"{path}/{name}")
    known = texts.join(lost, "rid", "left").select("whole", "lo", F.coalesce("n_removed", F.lit(0).cast("long")).alias("gone"), F.col("kept_sha256").alias("sha"))
    every = rows.select("doc_id", "ord", "n_words", "whole").join(known, "whole", "left")
    # all windows of a text are found in the smallest document that has it, so its copies keep nothing
    copy = F.coalesce(F.col("ord") > F.col("lo"), F.lit(False))
    return every.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"), F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("whole")))).alias("kept_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without what smaller ones have in windows of 50 words."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
