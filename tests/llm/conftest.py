import pytest

ODD_DOCUMENTS = [
    (0, None, "en", "a", 0),
    (1, "", "en", None, 0),
    (2, "   \n\t ", None, "b", 6),
    (3, "one", "en", "a", 3),
    (4, "One\ntwo  three", "en", "a", 14),
    (5, "one two three", "de", "b", 13),
    (6, "one two three", "de", "b", 13),
    (6, "one two three", "de", "b", 13),
    (7, "größe 日本語 😀 " * 40, "ja", "c", 560),
    (8, "the quick brown fox jumps over the lazy dog " * 30, "en", None, None),
    (9, "the quick brown fox jumps over the lazy dog " * 30 + "end", "en", "c", 1323),
    (None, "no id at all, only words that stand here", "en", "c", 1),
    (None, None, None, None, None),
    (10, "word%d " * 3 + " ".join(f"w{i}" for i in range(20_000)), "en", "a", 1),
    (11, "x" * 30_000, "en", "a", 30_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long, tied and repeated rows, and columns named like operators' own."""
    extra = [(*row, i, f"t{i}", [i]) for i, row in enumerate(ODD_DOCUMENTS)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, score string, size array<int>"
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf):
    """doc_id -> text of the smallest data set, null as empty."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
