"""Small awkward inputs shared by the tests of the training-data operators."""

import pytest

SF = "/root/testdata/sf0.001"
#: Null, empty, blank, repeated and very long texts; a repeated row; columns whose names operators use inside.
AWKWARD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "one two", "en"), (4, "one two", "en"), (5, "word " * 40_000, "en"), (6, "9" * 60_000 + "@" + "." * 1000, None), (7, "a" * 100_000, "de"), (8, "One\ttwo", "fr"), (None, "no id here", "en")]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, 0.5, "k", 7, b"x", 3) for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kind string, component_id int, ck binary, slot int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
