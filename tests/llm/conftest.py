from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.tables import importable

LONG = " ".join(f"word{i % 701}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, ties, rows repeated as a whole, names that operators use inside.
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1, 0, "x", 0.5),
    (1, "one two three four five six seven eight nine ten", "en", "a", 1, 0, "x", 0.5),
    (1, "the same id with another text", None, None, None, None, None, None),
    (2, None, "en", "a", None, 1, "x", 0.5),
    (3, "", "de", "a", 0, 1, "x", 0.5),
    (4, " \n\t ", "de", None, 3, 1, "x", 0.5),
    (5, "?!", "de", "b", 2, 1, "x", 0.5),
    (None, "no id at all", "en", "b", 12, None, None, None),
    (None, None, None, None, None, None, None, None),
    (6, LONG, "en", "b", len(LONG), 2, "y", 1.0),
    (7, "日本語 é́ ▁ <s> 😀", "ja", "b", 9, 2, "y", 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, score double"


@pytest.fixture(autouse=True)
def _importable(spark: SparkSession) -> None:
    importable(spark)


@pytest.fixture
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)

