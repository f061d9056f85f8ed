import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def documents(spark):
    """documents(text…) -> a documents table with ids from 0; a tuple gives (doc_id, text, source)."""

    def make(*texts, extra=False):
        rows = []
        for i, text in enumerate(texts):
            doc_id, text, source = text if isinstance(text, tuple) else (i, text, f"s{i % 3}")
            rows.append((doc_id, text, "en", source, None if text is None else len(text)))
        table = spark.createDataFrame(rows, SCHEMA)
        if extra:  # names that the operators use themselves
            for name in ("_row", "_words", "bucket", "before", "rank", "shard", "_items", "_turn", "node", "kept", "_source", "_slot"):
                table = table.selectExpr("*", f"1 as `{name}`")
        return table

    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and blank texts, repeats, a very long text, and clashing column names."""
    long = " ".join(f"word{i % 9973} of{i % 7919}" for i in range(60_000))
    return documents(
        (None, None, None), (1, None, "a"), (2, "", None), (3, " \n\t \n", "a"), (4, "short", "a"), (4, "short", "a"), (5, long, "a"),
        (5, "another text of the same id", "b"), (None, "a text without an id", "b"), (6, "short", ""), extra=True)
