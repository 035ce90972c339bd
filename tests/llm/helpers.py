"""Small tables with the awkward cases, and plain versions of what the operators compute."""

import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have columns of these names.
CLASHING = ["_id", "digest", "key", "kept", "_source", "_size", "_words", "_copy", "size", "fold", "rows", "count", "batch", "file"]


def words(text):
    return WORD.findall((text or "").encode().lower())


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def awkward(spark, extra=False):
    """Nulls in any column, empty and long texts, ties, repeated rows; with extra, columns of clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix vexing potions near a frozen lake at dawn "
    rows = [
        (1, base * 3, "en", "a", 10), (2, base * 3, "en", "a", 10), (3, base * 3 + "end", "en", None, 10), (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \n\t ", "en", "b", 4),
        (7, "one two", "en", "c", 7), (8, "one two", "en", "c", 7), (8, "one two", "en", "c", 7), (9, "Ünïcode ёлка 日本語 text", "xx", "c", 20), (10, "word " * 60000, "en", "a", 300000), (None, "no id here at all today", "en", "a", 5), (11, "x" * 5000, "en", "d", 5000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=40):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(n)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
