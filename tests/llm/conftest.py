import pytest

SF = "/root/testdata/sf0.001"
#: Internal names of the operators, as columns of the input: they must not clash.
EXTRA = ["rep", "hash", "fp", "rid", "row", "top", "content", "part", "keep_id", "score"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, ties, a very long text, clashing columns."""
    line = "The same line, long enough to count"
    texts = [
        (1, "Alpha beta gamma delta"), (2, "alpha BETA gamma delta"), (3, None), (4, ""), (5, " \t\n"), (6, f"{line}\nfirst\n{line}"), (7, f"  {line.upper()} \nsecond"),
        (7, f"  {line.upper()} \nsecond"), (7, f"another text under an id that repeats\n{line}"), (None, "alpha beta GAMMA delta"), (None, None), (8, "É é Ü ü ñ"), (9, "é é ü ü ñ"),
        (10, "x" * 70_000), (11, ("word " * 30_000) + "tail"), (12, "one"), (13, "two words"), (14, "\n\n\n"), (15, "12345 !!! ???"),
    ]
    rows = [(i, t, None if k % 3 else "en", f"s{k}", None if t is None else len(t), *[str(k)] * len(EXTRA)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
