import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (id, text[, lang]) rows."""

    def make(rows, start=0):
        full = []
        for i, r in enumerate(rows, start):
            doc_id, text, lang = (i, r, "en") if r is None or isinstance(r, str) else (*r, "en")[:3]
            full.append((doc_id, text, lang, "s", None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Null id and text, empty and blank texts, repeated rows, a long text, extra columns with awkward names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "mit license"), (4, "mit license"), (None, "no id here"), (None, None), (5, long), (6, "123 !!!"), (7, "é")]
    return docs_of(rows).withColumns({"score": F.lit("x"), "n": F.lit(1), "_id": F.lit(2), "at": F.lit("y"), "words": F.lit(3), "kept": F.lit(4)})


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
