import pytest

#: Nulls, empty and tiny texts, ties, repeated rows, repeated passages, a long text and awkward characters.
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"
TEXTS = [
    None, "", " \n\t ", "one", "One two", "a b c d e", "A b C d E", LINE, LINE, LINE.upper(), f"{LINE}\n{LINE}", f"{LINE} {LINE} extra words follow here",
    "\x00nul \x0b bytes   sep   nbsp café \U0001f600 emoji", "x " * 300, "All rights reserved. CC BY-NC 4.0 general PUBLIC license", " ".join(f"w{i}" for i in range(4000)),
    " ".join(f"w{i}" for i in range(4001)), "# * $ % & | < > ###", "y" * 3000, "abc" * 700,
]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns whose names clash with ours, and a repeated row."""
    rows = [(i, t, "x", 1.0, "y") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "x", 1.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, hash double, component_id string")


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
