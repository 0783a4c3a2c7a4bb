import datetime  # noqa: F401

import pytest


@pytest.fixture(scope="session")
def docs_df(spark):
    """``docs_df([(doc_id, text), ...])`` with the columns of ``documents`` plus one with a clashing name."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", None if t is None else len(t), "x") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, n_words string")

    return make
