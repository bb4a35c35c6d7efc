"""Small documents that every operator meets: nulls, empty, blank and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_t string, id long, rep long, n long, size long, component long, _k long, _row string, _gone long, bucket int, held_out boolean, score double"


def words(seed, n, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def rows(n=60, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i, " ".join(words(i, r.randrange(5, 80))), "en", f"s{i % 3}", 1))
    return out


EDGES = [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n ", None, "s1", 4), (1003, "one", "en", None, 3), (1004, "x" * 70_000, "en", "s0", 70_000), (1005, "tie tie tie", "en", "s2", 11), (1005, "tie tie tie", "en", "s2", 11), (None, "no id at all here", "en", "s0", 5)]


def frame(spark, data, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, SCHEMA)
    if clash:
        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
