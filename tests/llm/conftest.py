import pytest

EDGE = [
    (9001, None, "en", "a", 0),
    (9002, "", None, "a", 0),
    (9003, "one", "en", None, 3),
    (9004, "one", "en", None, 3),
    (9005, "two  words\n\n", "de", "b", 11),
    (9006, "x" * 5000, "en", "b", 5000),
    (9007, "word " * 3000, "en", "c", 15000),
    (9008, "Ünïcode ça va bien \U0001f600 fin", "fr", "c", 20),
    (9008, "Ünïcode ça va bien \U0001f600 fin", "fr", "c", 20),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, very short and very long texts, ties, a repeated row and a clashing extra column."""
    return spark.createDataFrame([(*r, "x") for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def few_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

CLASHES = ["fp", "FP", "component_id", "moved", "root", "h", "row", "u", "s", "block", "dir", "license", "score", "label", "margin", "kind", "_row"]


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """The edge documents with columns named like those that operators make for themselves; "FP" and "fp" cannot stand together."""
    return edge_docs.selectExpr("*", *(f"doc_id % 7 as `{n}`" for n in CLASHES if n != "FP"), "array(text) as `names`")
