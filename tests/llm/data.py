"""Small tables with the awkward cases that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space."""
    r = random.Random(5)
    words = ["the", "of", "And", "tion", "ER", "stst", "é", "ñandú", "straße", "a"]
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, "   \t\n ", None, None, 6),
        (4, "Same TEXT here", "en", "b", 14),
        (5, "same text here", "fr", "b", 14),
        (5, "same text here", "fr", "b", 14),
        (6, "two  spaces\n\nand odd   white space ", "de", "é", 40),
        (7, "<|endoftext|> stays text, it's", "en", "b", 30),
        (None, "no id here at all", "en", "a", 17),
        (None, None, None, None, None),
        (8, " ".join(r.choice(words) for _ in range(30_000)), "en", "a", 100_000),
        (9, "É é \U0001f600 astral", "fr", "a", 12),
        (10, "12345 !!! ???", "en", "c", 13),
    ]
    rows += [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(1, 60))), "en", r.choice("abc"), 1) for i in range(60)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def clashing(df):
    """``df`` with more columns, under names that operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("size", "length", "score", "h", "bucket", "token", "node", "copies", "rid", "tie", "toxic_score", "_h", "_g", "_id", "_lost", "_copy", "_copies", "_doc_id", "_source", "_size", "row", "d", "s", "id", "lost", "key", "more", "x`y"):
        df = df.withColumn(name, F.lit("x"))
    return df
