"""Documents with every awkward case, and the labelled test tables."""

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, label string, key string, score double, n_words long, bucket string, _text string"
)
EXTRA = ("r", "l", "k", 0.5, 3, "b", "t")


def rows_of(texts):
    return [(i, t, lang, src, len(t or ""), *EXTRA) for i, (t, lang, src) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    plain = "The quick brown fox jumps over the lazy dog near the river bank while many people watch and then walk home again."
    rows = rows_of(
        [
            (plain, "en", "a"),
            (None, "en", "a"),
            ("", None, None),
            (" \t\n ", "fr", "b"),
            ("word " * 12_000 + "x" * 3_000, "en", "a"),
            ("12 34 !!", None, "b"),
            (plain + " Truly.", "en", "a"),
            ("déjà vu 中文 \U0001f600 é", "fr", "b"),
        ]
    )
    rows.append(rows[0])  # a repeated row
    rows.append((0, "another text of the same id", "en", "a", 27, *EXTRA))
    rows.append((None, plain, None, "c", None, *EXTRA))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
