import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table."""
    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1]))
                for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            df = df.withColumn(name, df["doc_id"] * 0 + 7)
        return df

    return make


@pytest.fixture
def table(spark, tmp_path):
    """A DataFrame as a Parquet table, which reads alike at each scan."""
    n = [0]

    def put(df):
        n[0] += 1
        path = str(tmp_path / f"t{n[0]}")
        df.write.parquet(path)
        return spark.read.schema(T.StructType(df.schema.fields)).parquet(path)

    return put
