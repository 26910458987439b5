"""Op 6. N-gram Jaccard join by rare-first prefix filtering.

Shingles are ordered by how common they are, then by hash. Two sets as similar as asked share one of
the first ``n - ceil(share * n) + 1`` shingles of each, so sets are joined on those prefixes alone.
Equal sets are one node from the start. A pair that shares a prefix shingle is dropped by the filters on
length, position (what can still follow the shared one) and suffix (sets are cut into ``PARITY`` parts by
hash; a part whose size is even in one and odd in the other holds a shingle that only one of them has);
what is left is verified once, on the whole sets.

How common a shingle is comes from counts by hash over the whole table, of bounded size. The sets that
share a prefix shingle are first compared with the one among them that has it earliest, which is the
likeliest to be what the others were copied from; then, of the sets that this hasn't joined, each with
all others that it isn't joined with. So large groups of copies cost as many comparisons as they have
members, and every link still counts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, discard, staged, whole_rows, work_dir
from .graph import components

WORDS = 3
PERCENT = 90
#: Slots of the counts by hash, and parts they are summed in.
COUNT_BITS = 23
COUNT_PARTS = 64
#: Shingles that a worker holds before it counts them.
HELD = 1 << 20
#: Parts of a set whose parity the suffix filter compares.
PARITY = 512
MARKS = [f"p{k}" for k in range(PARITY // 64)]

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def shingle_hashes(text: str | None, width: int = WORDS):
    """Sorted 64-bit hashes of the distinct shingles of ``text``."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, "uint64")  # a short text's only shingle is no shingle of a longer one
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(30)
    return np.unique(out)


def signature(hashes) -> bytes:
    """16 bytes that stand for a whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def least_overlap(n_a, n_b, percent: int):
    """Shingles that sets of these sizes have to share."""
    return -(-(percent * (n_a + n_b)) // (100 + percent))


def _slot(hashes):
    import numpy as np

    return (hashes >> np.uint64(64 - COUNT_BITS)).astype("int32")


def parities(hashes):
    """Whether each of the PARITY parts of the set has an odd size, as longs."""
    import numpy as np

    odd = np.bincount((hashes >> np.uint64(20)).astype("int64") % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype("uint8")).view("<i8")


def _sets(docs: DataFrame, width: int, path: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, sig, parities and the columns ``h`` and ``g`` if there are any of every row; and how often
    shingles of each slot occur, one row for each task and range of slots. One pass over the texts.
    """
    own = [c for c in ("h", "g") if c in docs.columns]

    def sets(batches):
        import numpy as np
        import pandas as pd
        import zstandard

        seen, held, size = np.zeros(1 << COUNT_BITS, "<u4"), [], 0

        def flush():
            if held:
                slots, many = np.unique(np.concatenate(held), return_counts=True)
                seen[slots] += many.astype("<u4")
                held.clear()

        for pdf in batches:
            n, sig, odd = [], [], []
            for text in pdf["text"]:
                h = shingle_hashes(text, width)
                held.append(_slot(h))
                size += len(h)
                if size > HELD:
                    flush()
                    size = 0
                n.append(len(h))
                sig.append(signature(h) if len(h) else None)
                odd.append(parities(h))
            odd = np.array(odd, "int64").reshape(len(n), len(MARKS))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "sig": sig, **{c: odd[:, k] for k, c in enumerate(MARKS)}, "part": pd.array([None] * len(n), "Int32"), "counts": None, **{c: pdf[c] for c in own}})
        flush()
        press = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, press(x.tobytes())) for k, x in enumerate(np.split(seen, COUNT_PARTS)) if x.any()]
        nothing = lambda kind: pd.array([None] * len(parts), kind)
        yield pd.DataFrame({"doc_id": nothing("Int64"), "n": nothing("Int32"), "sig": None, **{c: nothing("Int64") for c in MARKS}, "part": [k for k, _ in parts], "counts": [x for _, x in parts], **{c: nothing("Int64") for c in own}})

    schema = ", ".join(["doc_id long, n int, sig binary", *(f"{c} long" for c in MARKS), "part int, counts binary", *(f"{c} long" for c in own)])
    rows = staged(docs.select("doc_id", "text", *own).mapInPandas(sets, schema), path)
    return rows.where("part is null").drop("part", "counts"), rows.where("part is not null").select("part", "counts")


def _levels(counts: DataFrame):
    """How common the shingles of each slot are, in eighths of powers of two: 2 ** COUNT_BITS bytes."""
    import numpy as np

    def summed(batches):
        import pandas as pd
        import zstandard

        sums: dict[int, np.ndarray] = {}
        inflate = zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            for part, raw in zip(pdf["part"], pdf["counts"], strict=True):
                x = np.frombuffer(inflate(raw), "<u8" if part < 0 else "<u4").astype("<u8")
                part = ~part if part < 0 else part
                sums[part] = sums[part] + x if part in sums else x
        press = zstandard.ZstdCompressor(level=1).compress
        # sums are marked by a negative part: their numbers are longer
        yield pd.DataFrame({"part": [~k for k in sums], "counts": [press(x.tobytes()) for x in sums.values()]}, columns=["part", "counts"]).astype({"part": "int32"})

    # the first time in salted parts, so that what a task reads at last doesn't grow with the number of tasks before
    salt = F.pmod(F.xxhash64("counts"), F.lit(16))
    sums = counts.repartition(COUNT_PARTS, "part", salt).mapInPandas(summed, "part int, counts binary")
    sums = sums.repartition(COUNT_PARTS, "part").mapInPandas(summed, "part int, counts binary")

    def graded(batches):
        import pandas as pd
        import zstandard

        for pdf in batches:
            x = [np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u8") for raw in pdf["counts"]]
            yield pd.DataFrame({"part": [~k for k in pdf["part"]], "level": [np.minimum(8 * np.log2(v + 1.0), 255).astype("uint8").tobytes() for v in x]})

    levels = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), "uint8")
    for r in sums.mapInPandas(graded, "part int, level binary").toLocalIterator():  # COUNT_PARTS rows
        levels[r["part"]] = np.frombuffer(r["level"], "uint8")
    return levels.reshape(-1)


def _prefixes(docs: DataFrame, levels, width: int, percent: int) -> DataFrame:
    """token, rid and place of the prefix shingles of every set, rarest first; and sig of each rid, in a row of
    its own. A copy in another task has another rid.
    """

    def prefixes(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        common, done, rid = levels.value, set(), TaskContext.get().partitionId() << 33

        def table(out, sigs):
            each, n = [len(x) for x in out], len(sigs)
            rids = np.arange(rid - n, rid)
            return pd.DataFrame({
                "token": pd.array(np.concatenate([*out, np.zeros(n, "int64")]), "Int64"), "rid": np.concatenate([np.repeat(rids, each), rids]),
                "place": np.concatenate([*(np.arange(k) for k in each), np.full(n, -1)]), "sig": pd.Series([None] * sum(each) + sigs, dtype=object),
            })

        for pdf in batches:
            out, sigs, size = [], [], 0
            for text in pdf["text"]:
                h = shingle_hashes(text, width)
                if not len(h):
                    continue
                sig = signature(h)
                if sig in done:  # a copy in the same task
                    continue
                if len(done) < 100_000:
                    done.add(sig)
                first = len(h) - -(-percent * len(h) // 100) + 1
                order = np.argsort(common[_slot(h)], kind="stable")[:first]  # h is sorted, so ties go by hash
                out.append(h[order].view("int64"))
                sigs.append(sig)
                rid += 1
                size += first
                if size >= 50_000:
                    yield table(out, sigs)
                    out, sigs, size = [], [], 0
            if out:
                yield table(out, sigs)

    return docs.select("text").mapInPandas(prefixes, "token long, rid long, place int, sig binary")


def _near(percent: int) -> Column:
    """Whether the filters on length, position and suffix leave a pair of rows with suffixes a and b."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))
    follow = F.least(n_a - F.col("place_a"), n_b - F.col("place_b"))
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in MARKS])
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (follow >= need) & (apart <= n_a + n_b - 2 * need)


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "place", *MARKS, *more)))


def _pair() -> list[Column]:
    return [F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")]


def _apart(lists: DataFrame, heads: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) of sets that share a list and aren't joined yet.

    In a list, the sets outside its largest component are compared with all others of it; its head was
    compared with everyone already.
    """
    member = lists.join(heads.where("size > 2").select("token", F.col("node").alias("head")), "token").where("node != head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = member.groupBy("token", "root").agg(F.count("*").alias("many"))
    largest = parts.groupBy("token").agg(F.max_by("root", F.struct("many", "root")).alias("largest"), F.count("*").alias("parts"))
    mixed = member.join(largest.where("parts > 1").select("token", "largest"), "token")
    a, b = _side(mixed.where("root != largest"), "a", "root"), _side(mixed, "b", "root")
    return a.join(b, (a["token"] == b["token"]) & (F.col("root_a") != F.col("root_b")) & _near(percent)).select(*_pair()).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, path: str) -> DataFrame:
    """The links among ``pairs`` (u, v), written to ``path``. Only the texts of their sets are read again."""
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    chosen = staged(nodes.join(asked, "node", "left_semi").select("node", "sig", "first_id"), f"{path}/asked")
    ids = chosen.select(F.col("first_id").alias("_id")).distinct()
    n = ids.count()
    few = n <= BROADCAST_KEYS
    again = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def hashes(batches):
        import pandas as pd

        for pdf in batches:
            found = [h for h in (shingle_hashes(t, width) for t in pdf["text"]) if len(h)]
            yield pd.DataFrame({"sig": [signature(h) for h in found], "set": [h.view("int64") for h in found]})

    by_sig = chosen.select("sig", "node")
    sets = again.mapInPandas(hashes, "sig binary, set array<long>").join(F.broadcast(by_sig) if few else by_sig, "sig").select("node", "set")
    if again.count() != n:  # only an id of several rows can give a set twice
        sets = sets.dropDuplicates(["node"])
    sets = staged(sets, f"{path}/sets")
    whole = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    both = F.size(F.array_intersect("set_u", "set_v"))
    links = staged(whole.where(both * (100 + percent) >= F.lit(percent) * (F.size("set_u") + F.size("set_v"))).select("u", "v"), f"{path}/links")
    discard(docs.sparkSession, f"{path}/sets")
    return links


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets are linked when 100 * intersection >= ``percent`` * union; every link counts, so components are
    exact. Null texts and texts without words have no shingles and are linked with nothing. Equal sets
    are linked. A component's id is its smallest doc_id; null ids are passed over (and give null where a
    component has no other). Rows that repeat stay; other columns are ignored.
    """
    return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """What jaccard_components() gives for ``docs`` (doc_id, text and maybe h and g), with h, g and ``part``.

    ``part`` tells components apart also where they have one id; it is null where there are no shingles.
    """
    spark = docs.sparkSession
    folder = work_dir(spark)
    rows, counts = _sets(docs, width, f"{folder}/sets")
    levels = spark.sparkContext.broadcast(_levels(counts))
    prefixes = staged(_prefixes(docs, levels, width, percent), f"{folder}/prefixes")
    levels.destroy()

    # what two rows share may be of copies alone; such lists are dropped where copies meet
    tokens, ids = prefixes.where("place >= 0").select("token", "rid", "place"), prefixes.where("place < 0").select("rid", "sig")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    lists = tokens.join(shared, "token", "left_semi").join(ids, "rid").groupBy("token", "sig").agg(F.min("place").alias("place"))
    lists = staged(lists, f"{folder}/lists")
    discard(spark, f"{folder}/prefixes")

    # the sets that share a prefix shingle get numbers
    chosen = rows.join(lists.select("sig").distinct(), "sig").groupBy("sig").agg(F.min("doc_id").alias("first_id"), *(F.min(c).alias(c) for c in ("n", *MARKS)))
    nodes = staged(chosen.withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    numbered = staged(lists.join(nodes.drop("first_id"), "sig").drop("sig"), f"{folder}/numbered")
    discard(spark, f"{folder}/lists")
    # lists of the same sets are one: that of the shingle that comes first has the true places
    heads = numbered.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), F.min(F.struct("place", "node")).alias("head")).where("size > 1")
    heads = heads.groupBy("size", "same").agg(F.min_by(F.struct("token", "head"), F.struct("head.place", "token")).alias("h")).select("h.token", "h.head.place", "h.head.node", "size")
    heads = staged(heads, f"{folder}/heads")
    few = heads.count() <= BROADCAST_KEYS
    tokens = heads.select("token")
    lists = staged(numbered.join(F.broadcast(tokens) if few else tokens, "token", "left_semi"), f"{folder}/kept")
    discard(spark, f"{folder}/numbered")

    first = _side(heads.join(nodes.select("node", "n", *MARKS), "node"), "b")
    stars = _side(lists, "a").join(first, "token").where((F.col("node_a") != F.col("node_b")) & _near(percent)).select(*_pair()).distinct()
    stars = staged(stars, f"{folder}/stars")
    links = _verified(stars, nodes, docs, width, percent, f"{folder}/first")
    roots = components(links, f"{folder}/joined")
    rest = staged(_apart(lists, heads, roots, percent).join(stars, ["u", "v"], "left_anti"), f"{folder}/apart")
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, nodes, docs, width, percent, f"{folder}/second"))
        roots = components(links, f"{folder}/all")

    named = nodes.select("node", "sig", "first_id").join(roots, "node").select("root", "sig", "first_id")
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("linked_id")), "root").select("sig", "root", "linked_id")
    # equal sets outside the lists, too
    own = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("own_id"))
    by_set = own.join(named, "sig", "left").select("sig", "root", F.least("own_id", "linked_id").alias("set_id"))
    by_set = staged(by_set, f"{folder}/by_set")
    for name in ("kept", "heads", "stars", "apart", "nodes", "first", "second", "joined", "all"):
        discard(spark, f"{folder}/{name}")
    part = F.coalesce(F.concat(F.lit("root "), F.col("root").cast("string")), F.hex("sig"))
    return rows.join(by_set, "sig", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("set_id")).alias("component_id"),
        part.alias("part"), *(c for c in ("h", "g") if c in rows.columns),
    )


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (null is above all others).

    Rows are told apart by doc_id and two hashes of the text; of rows that agree in both, one stays. Rows
    without shingles stay. Columns of any name are passed through.
    """
    folder = work_dir(docs.sparkSession)
    hashes = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    found = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", hashes[0].alias("h"), hashes[1].alias("g")), width, percent)
    found = staged(found.where("part is not null").select("part", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g").alias("key")), f"{folder}/found")
    best = found.groupBy("part").agg(F.min("key").alias("best"), F.count("*").alias("n")).where("n > 1").select("part", "best")
    keys = found.join(best, "part").groupBy("key", "best").agg(F.count("*").alias("n")).withColumn("stays", F.col("key") == F.col("best"))
    keys = keys.where("not stays or n > 1").select(F.col("key.doc_id").alias("id"), F.col("key.h").alias("kh"), F.col("key.g").alias("kg"), "stays")
    keys = staged(keys, f"{folder}/keys")
    discard(docs.sparkSession, f"{folder}/found")
    listed = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    keyed = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("d"), hashes[0].alias("h"), hashes[1].alias("g"))
    on = F.col("d").eqNullSafe(F.col("id")) & (F.col("h") == F.col("kh")) & (F.col("g") == F.col("kg"))
    rest = keyed.join(listed, on, "left_anti").select("row.*")
    if keys.where("stays").isEmpty():
        return rest
    repeats = keyed.join(listed.where("stays"), on, "left_semi").dropDuplicates(["d", "h", "g"]).select("row.*")
    return rest.unionByName(repeats)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at nine tenths of their 3-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
