import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "id string, found int, secrets string, fingerprint string, vector int"
)
EXTRA = ("x", 1, "y", "z", 2)
LONG = " ".join(f"word{k % 97} and{k % 13}" for k in range(30_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew for quiet queens"


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    texts = [
        (1, PROSE + ". One more.", "en"),
        (2, PROSE + ". One more.", "en"),
        (2, PROSE + ". One more.", "en"),
        (3, "", "en"),
        (4, None, "en"),
        (5, LONG, "en"),
        (6, "12345 67890", None),
        (7, "Über die Straße läuft İstanbul 漢字 😀 und so weiter", "de"),
        (8, "   \n\t  ", None),
        (9, 'token = "0123456789abcdef0123456789abcdef" ok', None),
        (None, PROSE + ". One more.", None),
        (None, None, None),
    ]
    full = [(i, t, lang, "src", None if t is None else len(t), *EXTRA) for i, t, lang in texts]
    return [*full, (None,) * 10]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}
