import pytest

EDGE = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 30), (2, "alpha  beta\tgamma delta epsilon", "en", "a", 30), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n", "de", "b", 2),
    (6, "Ünï cödé ☃ 𝒳 text", None, "c", 16), (7, "x" * 3000 + " " + "y z " * 500, "en", "a", 5001), (1, "alpha beta gamma delta epsilon", "en", "a", 30), (None, "no id here at all", "en", None, 17),
    (8, "one two", "en", "b", 7), (9, "One TWO", "en", "b", 7), (10, "<|endoftext|> and  spaces \n\n here ", "en", "c", 34),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("size", "key", "n", "uid", "grp", "digest", "cid", "score", "block", "node", "shard", "ids", "start", "part", "comp"):
        df = df.withColumn(name, df["lang"])
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture()
def scratch(spark):
    from tidemark.plans.scratch import Scratch

    return Scratch(spark, "test")
