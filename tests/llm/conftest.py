import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def texts():
    """doc_id, text of documents with what breaks text operators: nulls, blanks, repeats, long and non-ASCII texts, control strings."""
    words = " ".join(f"w{i % 97}x" for i in range(3000))
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa."), (3, None), (4, ""), (5, " \t\n "),
        (6, "one"), (7, "one two"), (8, words), (9, words + " tail"), (9, words + " tail"), (None, "alpha beta gamma"), (10, "naïve café ▁x ＡＫ́ 日本語 text\x00 with  two spaces \n\n"),
        (11, "<|endoftext|> Hello, WORLD. it's '’s ,, .. a,b x. y <|STARTOFTEXT|>"), (12, "#" * 5000), (13, "é" * 20_000), (14, "a " * 6000),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns that clash with what the operators name theirs."""
    rows = [(d, t, "en", "s", len(t or ""), "x", "y", 1) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, words string, n long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
