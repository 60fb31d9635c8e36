import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} und {i}" for i in range(40_000))
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position string, kept string, print string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    line = "The quick brown fox jumps over the lazy dog and runs far away from it, again and again."
    rows = [
        (1, line, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"),
        (5, line + " More words follow here.", "en", None), (6, "..!! 12 34 ..", "fr", "b"), (7, LONG, "en", "a"),
        (8, LONG + " tail", None, "c"), (9, line, "en", "a"), (9, line, "en", "a"), (None, line, "en", "a"),
        (None, None, None, None), (10, "éİß " + line[10:70] + " é", "fr", "c"), (11, "aaaa" * 60, "en", "c"),
        (12, "b" + "aaaa" * 30, "en", "c"), (12, "other text with the id of its neighbour", "de", "b"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), "p", "k", "q") for r in rows]
    return spark.createDataFrame(full, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))
