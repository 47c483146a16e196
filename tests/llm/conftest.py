"""Small tables for the operators of tamis.llm."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=False):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in (enumerate(texts) if not isinstance(texts, dict) else texts.items())]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:  # names that operators use themselves
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(7) for k in ("key", "fp", "run", "digest", "row", "ids", "score", "size", "nth", "id")})
        return df

    return make
