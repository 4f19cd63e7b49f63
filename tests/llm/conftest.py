import pytest

from pyspark.sql import functions as F

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    prose = [" ".join(word() for _ in range(120)) for _ in range(6)]
    passage = " ".join(word() for _ in range(70))
    near = prose[0].split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one two", "one two", "a b c d e", prose[0], prose[0], " ".join(near), prose[1],
             prose[2] + " " + passage + " " + prose[3], "start " + passage + "\nmore " + prose[4],
             prose[5] + " password=abc123XYZ end", "É漢字 😀 ß " * 30, " ".join(word() for _ in range(30000)),
             "key " + "0123456789abcdef" * 2 + " AKIA" + "ABCDEFGH12345678 x", "x***y*** " * 40]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, prose[1], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("doc", "counts", "secrets", "ids", "sig", "known", "known_", "spans", "n", "item_id", "start", "key", "shard"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
