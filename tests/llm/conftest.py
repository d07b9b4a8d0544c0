import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use inside; as extra columns they must do no harm.
CLASHES = ("_id", "_row", "_text", "block", "row", "content", "words", "n_tokens", "lang_pred", "component", "key")


@pytest.fixture
def documents(spark):
    """Rows of (id, text) or (id, text, lang) as ``documents`` with clashing extra columns."""

    def make(rows, clashes=True):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        for name in CLASHES if clashes else ():
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def files(tmp_path):
    return lambda: f"file://{tmp_path}"
