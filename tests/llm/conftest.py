import pytest

SF = "/root/testdata/sf0.01"

ODD = [
    (1, "", "en", "a"),
    (2, None, None, None),
    (3, "one two three four five six seven", "en", "a"),
    (4, "one two three four five six seven", "en", "b"),
    (4, "one two three four five six seven", "en", "b"),
    (5, "one  two\tthree four\nfive six seven", "en", "b"),
    (6, "short", "de", "b"),
    (7, "x" * 5000, "de", "b"),
    (8, "mail bob@example.org or +1 (988) 555-2485, 10.0.0.1\n4539578763621486 end", "de", "b"),
    (None, "no id here", "de", None),
    (9, " \n \n ", "de", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns with names that operators may use inside."""
    rows = [(*r, 0, "h", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, row int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
