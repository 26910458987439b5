"""Op 2. Exact dedup through an extendible-hash index on shared files, in DataFrame operations only.

A row's key is the 64-bit hash of its normalised text. The directory has a slot for each run of leading
bits of the hash; a bucket owns the slots that agree in its first ``depth`` bits. Depth starts at
``START_DEPTH`` and grows by one bit, doubling the slots in use, wherever a bucket would hold more than
``capacity`` keys; where that takes more bits than the directory has, the slots of overfull buckets alone
get more, up to all 64. The directory comes first, and says which owner task gets a row: in its range of
buckets the owner puts the rows of a hash together, compares the bytes of those that aren't alone, makes the
chain of their different texts, and picks the row that stays. It writes its chains, in order, to one file. A
row finds what it belongs to by hash, slot, bucket and chain, and nothing else says what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, discard, lower_ascii, staged, whole_rows, work_dir

CAPACITY = 8192
START_DEPTH = 2
#: Bits that overfull slots get at once.
MORE_BITS = 8
NO_ID = -(1 << 63)

SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


def normal(text):
    """Null as empty, A-Z in lower case.

    ``lower`` is much faster than ``translate`` and does the same where no other letter has a case to lose.
    """
    text = F.coalesce(text, F.lit(""))
    others = text.rlike(r"[[^\x00-\x7F]&&[\p{javaUpperCase}\p{javaTitleCase}]]")
    return F.when(others, lower_ascii(text)).otherwise(F.lower(text))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h and sha of every row."""
    return docs.select("doc_id", normal(F.col("text")).alias("t")).select("doc_id", text_hash(F.col("t")).alias("h"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"))


def leading(h: str, bits: int) -> Column:
    """The first ``bits`` bits of a hash, as a number."""
    return F.shiftrightunsigned(h, 64 - bits)


def directory(keys: DataFrame, path: str, capacity: int = CAPACITY, start: int = START_DEPTH) -> list[tuple[int, DataFrame]]:
    """The directory of keys ``h``, each counted once: (bits, table of slot, bucket and depth), one for each width of slots.

    A slot is the first ``bits`` bits of a hash; its bucket is the first hash that the bucket can own. A
    null bucket means that the slot was split again and its keys have slots in the next table. Every depth
    up to ``bits`` is counted at once; a slot belongs to the shallowest bucket that isn't overfull, which
    is where splitting bucket after bucket would have ended.
    """
    found, low, wide, of = [], start, max(1, keys.count() // capacity).bit_length() + 2, keys
    while True:
        bits = min(64, max(wide, low))
        slots = of.groupBy(leading("h", bits).alias("slot")).agg(F.count_distinct("h").alias("n"))
        levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits))))
        levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
        loads = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("load"))
        shallowest = F.min(F.when(F.col("load") <= capacity, F.col("depth")))
        depths = levels.join(loads, ["depth", "prefix"]).groupBy("slot").agg(shallowest.alias("depth"))
        table = staged(depths.select("slot", F.expr(f"shiftleft(shiftrightunsigned(slot, {bits} - depth), 64 - depth)").alias("bucket"), "depth"), f"{path}/directory{bits}")
        found.append((bits, table))
        over = table.where("bucket is null")
        if over.isEmpty():
            return found
        of = staged(of.withColumn("slot", leading("h", bits)).join(over.select("slot"), "slot", "left_semi").select("h"), f"{path}/over{bits}")
        low, wide = bits + 1, bits + MORE_BITS


def in_buckets(rows: DataFrame, slots: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (with h) and the bucket and depth that the directory gives for each."""
    out, left = None, rows
    for k, (bits, table) in enumerate(slots):
        few = table.count() <= BROADCAST_KEYS
        found = left.withColumn("slot", leading("h", bits)).join(F.broadcast(table) if few else table, "slot").drop("slot")
        last = k == len(slots) - 1
        done = found if last else found.where("bucket is not null")
        out = done if out is None else out.unionByName(done)
        left = found.where("bucket is null").drop("bucket", "depth")
    return out


def chains(docs: DataFrame, placed: DataFrame, slots: list[tuple[int, DataFrame]], path: str) -> DataFrame:
    """bucket, depth, h, link, links, sha, keep_id, keep_rid and group_size of every different text.

    ``placed`` are the rows in their buckets. ``docs`` is read again for the texts whose hash comes more than
    once; they go to the same buckets, and there their bytes are compared. One text makes a chain of one link,
    which every row of the hash belongs to. Where a hash has several texts, each is a link, and its SHA-256
    marks its rows; should two texts agree in both hashes, the job fails.
    """
    order = F.coalesce("doc_id", F.lit(NO_ID))
    keys = placed.groupBy("bucket", "depth", "h").agg(F.min("sha").alias("sha"), F.max("doc_id").alias("keep_id"), F.max_by("rid", order).alias("keep_rid"), F.count("*").alias("group_size"))
    keys = staged(keys, f"{path}/keys")
    again = keys.where("group_size > 1").select("h")
    few = again.count() <= BROADCAST_KEYS
    texts = docs.select(normal(F.col("text")).alias("t")).withColumn("h", text_hash(F.col("t")))
    texts = in_buckets(texts.join(F.broadcast(again) if few else again, "h", "left_semi"), slots)
    # a text is its own key within its bucket: Spark compares the bytes, first within each task
    texts = staged(texts.groupBy("bucket", "h", "t").agg(F.count("*").alias("n")).select("bucket", "h", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), "n"), f"{path}/texts")
    several = texts.groupBy("bucket", "h").agg(F.count("*").alias("links")).where("links > 1")
    alone = keys.withColumns({"link": F.lit(1), "links": F.lit(1).cast("long")})
    if several.isEmpty():
        return alone
    several = staged(several, f"{path}/several")
    own = ["bucket", "h"]
    groups = placed.join(several, own, "left_semi").groupBy("bucket", "depth", "h", "sha").agg(F.max("doc_id").alias("keep_id"), F.max_by("rid", order).alias("keep_rid"))
    link = F.row_number().over(Window.partitionBy(*own).orderBy("sha"))
    linked = texts.join(several, own).groupBy(*own, "sha", "links").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).withColumn("link", link)
    sound = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("different texts with one hash and one SHA-256")).cast("long"))
    linked = linked.withColumn("group_size", sound).join(groups, [*own, "sha"]).select(*alone.columns)
    return alone.join(several, own, "left_anti").select(*alone.columns).unionByName(linked)


def build_index(docs: DataFrame, entries: DataFrame, path: str, capacity: int = CAPACITY) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Write the index of ``entries`` (hashed rows with ``rid``) under ``path``: its bucket files and directory."""
    slots = directory(entries.select("h"), path, capacity)
    owned = chains(docs, in_buckets(entries, slots), slots, path).repartitionByRange(F.col("bucket"))
    return staged(owned.sortWithinPartitions("bucket", "h", "link"), f"{path}/buckets"), slots


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, h, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Null texts count as empty; rows that repeat count one by one and exactly one row of a group is kept,
    that of the largest doc_id (a null doc_id is below all others). Other columns are ignored.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    entries = staged(hashed(docs).withColumn("rid", F.monotonically_increasing_id()), f"{path}/entries")
    index, slots = build_index(docs, entries, path, capacity)
    for name in ("keys", "texts", "several"):
        discard(spark, f"{path}/{name}")
    links = index.select("bucket", "h", "links", F.col("sha").alias("link_sha"), "keep_id", "keep_rid", "group_size")
    found = in_buckets(entries, slots).join(links, ["bucket", "h"]).where("links = 1 or sha = link_sha")
    return found.select("doc_id", "h", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns of any name are passed through.

    Rows that go are few or many: their keys are counted before they are sent to every executor. Rows
    that repeat the id and text of the one that stays are told apart only here, among themselves.
    """
    groups = exact_groups(docs, capacity)
    lost = groups.where("not kept").groupBy("doc_id", "text_sha256").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"))
    lost = staged(lost.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("lost"), "stays"), f"{work_dir(docs.sparkSession)}/lost")
    few = lost.count() <= BROADCAST_KEYS
    keys = F.broadcast(lost) if few else lost
    keyed = docs.select(whole_rows(docs), F.col("doc_id").alias("d"), F.unhex(F.sha2(normal(F.col("text")).cast("binary"), 256)).alias("s"))
    on = F.col("d").eqNullSafe(F.col("id")) & (F.col("s") == F.col("lost"))
    rest = keyed.join(keys, on, "left_anti").select("row.*")
    if lost.where("stays").isEmpty():
        return rest
    repeats = keyed.join(keys.where("stays"), on, "left_semi").dropDuplicates(["d", "s"]).select("row.*")
    return rest.unionByName(repeats)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")
