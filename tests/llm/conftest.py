import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest whole documents table, for checks against brute force."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


#: Rows every operator must take: nulls in each column, empty and odd texts, ties, repeated rows.
AWKWARD = [
    (1, "plain words in a row that are long enough to count here", "en", "a", 10),
    (1, "plain words in a row that are long enough to count here", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", "de", None, 5),
    (None, "a text without an id", "fr", "b", 9),
    (5, "word " * 3000, "en", "b", 15000),
    (6, "ünïcödé \U0001f600 naïve <|endoftext|> é", "xx", "ß", 7),
    (7, "x", "es", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """AWKWARD with columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES})


#: Names that the operators use for columns of their own.
CLASHES = (
    "fp", "node", "size", "target", "rate", "length", "rank", "key", "idx", "count", "score", "line", "leaf", "h", "u", "v", "f", "id", "d", "tag", "row", "lines", "dropped", "kept",
    "copy", "of_source", "__rate", "__source", "__d", "__tag", "__lines", "__dropped", "__id", "__copy", "accepted", "component", "f0", "k0", "shingles", "label", "a.b",
)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
