import pytest

LONG = "word " * 30_000
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog."),
    (2, "The cat sat on the mat and looked at the dog."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (None, "no id here"),
    (7, "Ünï çödé 日本 😀 $$$ 123"),
    (8, "THE CAT\x0bSAT\x1con\x85it"),
    (9, "12345 !!! ???"),
    (1, "The cat sat on the mat and looked at the dog."),
    (10, "unbroken" * 2_500),
    (11, "stop <|endoftext|> go<|endoftext|>"),
    *[(None, "no id here")] * 5,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, a repeated row, and columns with clashing names."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, 0.5, 7, "x") for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, score double, shard int, id string"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
