import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (id, text) pairs; ``extra`` adds columns whose names clash with those of operators."""

    def make(texts, extra=False, langs=None):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        rows = [(i, t, langs[k] if langs else "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "key", "line", "block", "bucket", "component", "n", "kept", "range", "size", "__n", "group"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make


@pytest.fixture
def odd_texts():
    """Nulls, empties, ties, repeated rows, and one long text."""
    long = " ".join(f"word{i % 977} x{i % 13}" for i in range(30_000))
    return [None, "", " \n\t", "a", "a", "same words here again and once more for all", "same words here again and once more for all", long, "ünïcödé ß 漢字 🙂", None]
