from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class string, key long, n int, rid long, label int, leaks string, pii string"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties and repeats, under columns whose names operators use inside."""
    line = "Then the old man said that he would go down to the sea again and wait there for the boats."
    rows = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "Two words"), (6, line), (7, line), (7, line), (8, line.upper()),
        (9, line.replace("boats", "ships")), (None, line), (None, None), (10, "x" * 200_000), (11, " ".join(f"w{k}" for k in range(40_000))),
        (12, "a@b.co 1.2.3.4, +1 (743) 555-3824, 4111 1111 1111 1111"), (13, "\n".join([line] * 300)),
    ]
    return spark.createDataFrame([(*r, "en", None, None, "c", 1, 2, 3, 4, "l", "p") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
