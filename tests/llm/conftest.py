import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text[, source]) rows; extra columns have names that operators use themselves."""
    from tabsplit.llm.common import prepare

    prepare(spark)

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(1) for c in ("size", "place", "key_a", "score", "ids_", "u", "component", "label", "start")})
        return df

    return make


def words(*numbers):
    return " ".join(f"word{n}" for n in numbers)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, an id with two texts, one very long word and one very long text."""
    long_text = " ".join(f"t{k * 7919 % 5003}" for k in range(20_000))
    return [
        (1, None), (2, ""), (3, "  \n\t "), (None, "a null id has words too"), (4, "same text twice here"), (4, "same text twice here"), (5, "one id"), (5, "two texts under it"),
        (6, "x" * 50_000), (7, long_text), (8, long_text), (9, "Ünïcode ▁ ßtraße   日本語 \U0001F600 <|endoftext|> end", None),
    ]
