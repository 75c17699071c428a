import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Null and empty texts, null ids, repeated rows, ties, odd white space, a long text.
TEXTS = [
    (1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (2, "one two three four five six seven eight"),
    (3, None), (None, "one two three four five six seven eight"), (None, None), (4, ""), (5, " \t\n\x0b "), (6, "word"), (7, "two words"),
    (8, "Mail a.b@c-d.example.org, call +1 (555) 123-4567, from 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111!"),
    (9, "x" * 3000 + " " + "long text it's 'll\n" * 4000), (10, "日本語 naïve Ünï 😀 <|endoftext|> ok"), (11, "same line\nsame line\nsame line\nother"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None][k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(c) for c in ["fp", "id", "row", "key", "words", "failed", "copy", "bucket", "m1", "ids", "host", "u", "n"]})


@pytest.fixture(scope="session")
def bpe_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
