import pytest

#: Texts with the corners: nulls, empty, blank, ties, repeats, very long, several scripts.
CORNERS = [None, "", " \t\n", "a", "a b c", "x " * 20, "émile ß 你好 \U0001f642", "same words here " * 12, "same words here " * 12, "\n\n\r\x0b\x0c", "word\x85nbsp\xa0thin end"]


@pytest.fixture(scope="session")
def corner_docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(CORNERS)]
    rows += [(None, "no id", None, None, None), (3, "a", "en", "s1", 1), (100, "long " * 40_000 + "end", "en", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def no_docs(corner_docs):
    return corner_docs.limit(0)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
