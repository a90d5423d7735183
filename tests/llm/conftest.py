import pytest
from pyspark.sql import SparkSession

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark: SparkSession):
    """Builds a table of documents from (doc_id, text) or (doc_id, text, lang), cut into a few partitions."""

    def build(rows, extra: str | None = None):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT).repartition(3)
        return df.selectExpr("*", extra) if extra else df

    return build
