import pytest

#: Texts that every operator meets: null, empty, blank, a tie, repeated rows, a very long one, odd characters.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, BASE, "en", "s"), (1, BASE, "en", "s"), (2, BASE, "en", "s"), (3, BASE + " tail", "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, "  \n\t ", None, "s"),
        (None, "a text without an id " + BASE, "en", "s"), (8, LONG, "de", "s"), (9, LONG + " and more", "de", "s"), (10, "ünï cödé 中文 \U0001f600 \\ <|im_end|>", "de", "s"), (11, "one", "en", "s"),
        (12, "ab " * 400, "fr", "s"), (13, "12345 67890", "fr", "s"), (2, "another text under a known id", "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    # extra columns whose names clash with those the operators use inside
    return df.selectExpr("*", "1 AS doc", "'x' AS th", "2 AS key", "3 AS n", "'y' AS score", "4 AS k", "5 AS block", "6 AS rep", "7 AS w", "'z' AS lang_pred", "8 AS spans")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
