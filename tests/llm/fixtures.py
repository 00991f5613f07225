"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows():
    a, b, long = words(80, 1), words(120, 2), words(3000, 3)
    near = a.split()
    near[40] = "changed"
    passage = words(60, 4)
    out = [
        (1, a, "en", "s1", 10), (2, a, "en", "s1", 10), (3, " ".join(near), "en", "s1", 1), (4, None, None, None, None), (5, "", "en", "s2", 0),
        (6, b, "de", "s1", 5), (7, b.replace(" ", "\n"), "de", "s1", 5), (8, long, "en", None, 9), (8, long, "en", None, 9), (9, words(30, 5) + " " + passage + " " + words(40, 6), "fr", "s1", 3),
        (10, words(20, 7) + " " + passage + " " + words(25, 8), "fr", "s2", 3), (11, "...!! 123", "en", "s2", 9), (None, a, "en", "s1", 2), (12, "one two", "en", "s1", 7), (13, "one two", "en", "s1", 7),
        (14, "ünï cödé \u2028 text 中文 😀", "de", "s3", 4), (15, "x" * 5000, "en", "s3", 5000),
    ]
    return out


def docs(spark, data=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    for c in ("node", "digest", "_gone", "stratum", "key", "h", "vector", "k_id", "d_id", "spans", "_text", "bucket", "rep"):
        df = df.withColumn(c, F.lit(1))
    return df
