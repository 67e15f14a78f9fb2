"""Small fixtures shared by the tests of the training-data operators."""

import random
import string

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """Rows of (doc_id, text[, lang[, source]]); ``extra`` adds columns whose names clash with internal ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "t", "fp", "skey", "h", "size", "row", "spans", "key", "shard", "component", "component_id", "bucket", "f0", "__mix"):
            df = df.withColumn(name, F.lit("x"))
    return df


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(n))


def rng(seed=1):
    return random.Random(seed)
