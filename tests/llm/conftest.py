import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CASES = [
    (1, "the quick brown fox jumps over the lazy dog and the small cat of the house", "en", "src0", 74),
    (1, "the quick brown fox jumps over the lazy dog and the small cat of the house", "en", "src0", 74),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (None, "a document without an id of its own", "en", "src0", 35),
    (4, "!!! ??? 123 ...", None, "src0", 15),
    (5, "und der hund ist mit dem mann auf der strasse", "de", "src2", 45),
    (6, "wort " * 30000, "de", "src2", 150000),
    (7, "x" * 200000, None, "src9", 200000),
    (8, "ünï çødé 漢字 🙂 the end", "fr", None, 23),
    (9, "the quick brown fox jumps over the lazy dog and the small cat of the house", "en", "src3", 74),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    return spark.createDataFrame(CASES, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with extra columns that operators might use themselves, some in another case."""
    from pyspark.sql import functions as F

    extra = "rank score fp key part block slot component_id signatures first_id _spans _keep h TEXT Doc_Id".split()
    names = [*odd_docs.columns, *extra]
    return odd_docs.select(*odd_docs.columns, *[F.lit("z").alias(f"x{i}") for i in range(len(extra))]).toDF(*names)
