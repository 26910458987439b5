"""Op 5. Token ids as separately compressed frames with a shared zstandard dictionary.

Layout under a folder, written by Spark so that any store Spark reaches will do:

``dictionary``  one row: the dictionary bytes and their SHA-256
``blocks``      one row per block of documents, in ascending doc_id order (``shard``, ``block``)

A block's ``payload`` is magic ``TIDZ``, the dictionary's SHA-256, the number of documents, an offset
index with a fixed-size entry per document, and the frames. A frame is one document's ids (unsigned
32-bit, little-endian) compressed by itself, so a short document is read by inflating its frame alone.
A block also says how many ids its shard has before it, so readers add up one row per shard and move no
payload.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, small_batches, work_dir
from .tokens import KEPT_WORDS, encoder

MAGIC = b"TIDZ"
BLOCK_BYTES = 1 << 20
#: Bytes of text in a shard, about; tables too small for it are dealt to all cores in parts of LEAST_BYTES.
SHARD_BYTES = 32 << 20
LEAST_BYTES = 1 << 20
DICTIONARY_BYTES = 65_536
DICTIONARY_DOCS = 2_000
LEVEL = 3
SLICE = 64

BLOCKS = "shard int, block int, first_id long, last_id long, n_docs int, in_shard long, n_ids long, dict_hash string, payload binary"


def _index_type():
    import numpy as np

    return np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("n_ids", "<u4"), ("offset", "<u8"), ("size", "<u4")])


def _encoded(texts, path: str, end_id: int) -> Iterator[bytes]:
    import numpy as np

    enc, end = encoder(path, "join"), np.array([end_id], dtype="<u4").tobytes()
    texts = ["" if t is None else t for t in texts]
    for i in range(0, len(texts), SLICE):
        for ids in enc.encode(texts[i : i + SLICE]):
            yield ids + end
    enc.forget(4 * KEPT_WORDS)


def train_dictionary(docs: DataFrame, n_docs: int, tokenizer_path: str, end_id: int, sample_docs: int = DICTIONARY_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the serialized ids of at most 2 * ``sample_docs`` of the ``n_docs`` documents.

    The sample is drawn by hash over the whole table; every document is encoded with the result. When
    there is too little to train on, the sample's bytes themselves serve as the dictionary.
    """
    import zstandard

    share = min(1.0, sample_docs / max(1, n_docs))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text").limit(2 * sample_docs)

    def ids(batches):
        import pandas as pd

        for pdf in batches:
            found = list(_encoded(pdf["text"], tokenizer_path, end_id))
            # long arrays are cut up, none of it is left out
            yield pd.DataFrame({"ids": [x[i : i + 16_384] for x in found for i in range(0, len(x), 16_384)]})

    samples, total = [], 0
    for row in drawn.mapInPandas(ids, "ids binary").toLocalIterator():
        samples.append(bytes(row["ids"]))
        total += len(samples[-1])
        if total > 100 * size:
            break
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or bytes([end_id % 256, 0, 0, 0]) * 8


@functools.lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def pack_block(entries: list[tuple], dict_hash: bytes) -> bytes:
    """The payload of ``entries``: (doc_id or None, number of ids, frame)."""
    import numpy as np

    index = np.zeros(len(entries), dtype=_index_type())
    at = 0
    for k, (doc_id, n, frame) in enumerate(entries):
        index[k] = (doc_id or 0, doc_id is not None, n, at, len(frame))
        at += len(frame)
    return b"".join((MAGIC, dict_hash, np.uint32(len(entries)).tobytes(), index.tobytes(), *(f for _, _, f in entries)))


def read_index(payload: bytes, dict_hash: bytes):
    """The offset index of a block, and where its frames begin."""
    import numpy as np

    if payload[:4] != MAGIC or payload[4:36] != dict_hash:
        raise ValueError("not a block of this dictionary")
    n = int(np.frombuffer(payload, "<u4", 1, 36)[0])
    index = np.frombuffer(payload, _index_type(), n, 40)
    return index, 40 + index.nbytes


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Write the ids of every row's whole ``text`` (null: empty), plus ``end_id``, under ``path``.

    Rows are dealt out by ranges of doc_id (nulls first, copies of an id spread by a hash of the text)
    and sorted, so shards in order and blocks in order are the documents in order. Other columns are
    ignored. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    there = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    dictionary = train_dictionary(docs, there["n"], tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    partitions = partitions or max(1, -(-there["size"] // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, there["size"] // LEAST_BYTES))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def blocks(batches):
        import pandas as pd
        from pyspark import TaskContext

        shard, block, entries, held, before = TaskContext.get().partitionId(), 0, [], 0, 0
        press = _codec(shared.value)[0].compress

        def done():
            ids = [e[0] for e in entries if e[0] is not None]
            return pd.DataFrame([(shard, block, min(ids, default=None), max(ids, default=None), len(entries), before, sum(e[1] for e in entries), digest.hex(), pack_block(entries, digest))], columns=["shard", "block", "first_id", "last_id", "n_docs", "in_shard", "n_ids", "dict_hash", "payload"]).astype({"first_id": "Int64", "last_id": "Int64"})

        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            for doc_id, raw in zip(ids, _encoded(pdf["text"], tokenizer_path, end_id), strict=True):
                entries.append((doc_id, len(raw) // 4, press(raw)))
                held += len(entries[-1][2]) + 32
                if held >= BLOCK_BYTES:
                    yield done()
                    block, before, entries, held = block + 1, before + sum(e[1] for e in entries), [], 0
        if entries:
            yield done()

    with small_batches(spark):
        ordered.mapInPandas(blocks, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").first()
    found = bytes(row["dictionary"])
    if hashlib.sha256(found).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary doesn't have its hash")
    return found


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) of every document, from the files alone.

    A start is what earlier shards hold (sums over one row per shard) and what its own shard holds before
    it, so no payload is read twice or moved.
    """
    dictionary = _dictionary(spark, path)
    digest, shared = hashlib.sha256(dictionary).digest(), spark.sparkContext.broadcast(dictionary)
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = table.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    few = sizes.count() <= BROADCAST_KEYS
    rows = table.select("shard", "in_shard", "payload").join(F.broadcast(shards) if few else shards, "shard").select((F.col("shard_start") + F.col("in_shard")).alias("start"), "payload")

    def documents(batches):
        import numpy as np
        import pandas as pd

        inflate = _codec(shared.value)[1].decompress
        for pdf in batches:
            for start, payload in zip(pdf["start"], pdf["payload"], strict=True):
                index, base = read_index(payload, digest)
                raw = [inflate(payload[base + o : base + o + s]) for o, s in zip(index["offset"].tolist(), index["size"].tolist(), strict=True)]
                n = index["n_ids"].astype("int64")
                out = pd.DataFrame({"doc_id": pd.array(index["doc_id"], dtype="Int64"), "start": int(start) + np.cumsum(n) - n, "n_tokens": [len(x) // 4 for x in raw], "ids_crc32": [zlib.crc32(x) for x in raw]})
                out.loc[index["has_id"] == 0, "doc_id"] = pd.NA
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<u4").astype("int64") for x in raw]
                yield out

    return rows.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document with this id; only its block is read and only its frame inflated."""
    import numpy as np

    dictionary = _dictionary(spark, path)
    digest, inflate = hashlib.sha256(dictionary).digest(), _codec(dictionary)[1].decompress
    found = []
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for row in blocks.orderBy("shard", "block").select("payload").toLocalIterator():
        payload = bytes(row["payload"])
        index, base = read_index(payload, digest)
        for e in index[(index["doc_id"] == doc_id) & (index["has_id"] == 1)]:
            at = base + int(e["offset"])
            found.append(np.frombuffer(inflate(payload[at : at + int(e["size"])]), "<u4").tolist())
    return found


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written, read back and digested."""
    import public_tokenizers

    path = work_dir(spark)
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(spark, path)
