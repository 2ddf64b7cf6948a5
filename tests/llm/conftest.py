import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, extra=False):
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:        # columns whose names operators use themselves
        for c in ("kept", "digest", "fp", "score", "part", "src_file", "src_row", "y", "html", "ids", "node", "rep"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties and repeats."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeghilnorst") for _ in range(rnd.randint(1, 9)))
    base = [" ".join(word() for _ in range(rnd.randint(1, 150))) for _ in range(30)]
    near = [b + " " + word() for b in base[:10] for _ in range(3)]
    return [None, "", "", None, " ", "\n\t ", "a", "A", "a b c", "Äa", "äa", "x" * 300_000, " ".join(["w"] * 60_000),
            "日本語 テキスト 🎉", *base, *base[:5], *[b.upper() for b in base[:5]], *near,
            "\n".join(["same line here"] * 40), "tab\tand\x0bvt\x1cfs nbsp x"]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
