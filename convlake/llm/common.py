"""What the operators of this subpackage share: work tables, text measures, filters by key."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that a filter sends to every executor (keys have at most about 100 bytes, so 25 MB); beyond it
#: the same filter is a shuffled join.
BROADCAST_KEYS = 250_000
#: Rows that a Python worker holds at once while a work table is written.
BATCH_ROWS = 1024


def work_dir(spark: SparkSession) -> str:
    """A new folder for work tables, under spark.checkpoint.dir, which executors share.

    Where that setting is absent (local tests) the warehouse folder is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-work/{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Within this, Python workers get at most ``rows`` rows at once: texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, path: str, rows: int = BATCH_ROWS, row_group: int | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written to ``path`` once, in batches of ``rows``, and read back, which cuts its lineage.

    Writer and reader hold one row group at once; ``row_group`` bounds it in bytes where rows are large (its
    size is then looked at after every row, where the writer by itself waits for a hundred). ``codec`` is Parquet's.
    """
    with small_batches(df.sparkSession, rows):
        writer = df.write.mode("overwrite")
        if row_group is not None:
            writer = writer.options(**{"parquet.block.size": row_group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
        if codec is not None:
            writer = writer.option("compression", codec)
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def whole_rows(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one, so that no name of theirs meets a name that an operator uses.

    ``select("row.*")`` gives them back.
    """
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias(name)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text`` as long; null text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal ``doc_id``, modulo ``modulus``: the fixed fold of a document.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def drop_keys(docs: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``column`` isn't in ``keys`` (one column of that name, no nulls).

    The keys are counted: a list of known size goes to every executor and the texts stay where they
    are; a longer one is joined by key.
    """
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, column, "left_anti")


def keep_keys(docs: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``column`` is in ``keys`` (distinct), by the same rule as drop_keys."""
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, column, "left_semi")
