from itertools import zip_longest

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and white texts, repeated rows, ties, other scripts, and columns with names that clash."""
    long = "word other third " * 400
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."), (2, "The quick brown fox jumps over the lazy dog and runs away."),
        (3, None), (4, ""), (5, " \n\t "), (None, "a row without an id"), (6, "日本語のテキスト мир "), (7, long), (8, "x"), (9, "😀 é ▁ \x00 <s>"), (10, "line one is here and long\nline one is here and long\nshort\n"),
    ]
    frame = spark.createDataFrame([(*r, "en" if r[0] else None, "s", 1, "k", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, id int")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


def same_rows(a, b):
    key = repr
    return all(x == y for x, y in zip_longest(sorted(a, key=key), sorted(b, key=key)))
