import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside.
CLASHING = (
    "score", "block", "share", "payload", "row", "fp", "n", "id", "component", "component_id", "u",
    "v", "key", "cell", "choice", "first", "spans", "rule", "links", "toxic", "gram", "part", "_row",
)


@pytest.fixture(scope="session")
def texts(spark):
    """Builds documents ``(doc_id, text)`` with further columns whose names clash."""

    def build(rows, extra=True):
        df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
        if extra:
            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return build


def values(df, *columns):
    """Rows as tuples, in an order that copes with missing values."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
