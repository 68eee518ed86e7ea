from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
# Extra columns whose names the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("segment", T.StringType()),
    T.StructField("pos", T.StringType()), T.StructField("line", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("rank", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("digest", T.StringType())])

LONG_LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    (1, LONG_LINE), (2, LONG_LINE), (3, None), (4, ""), (5, " \n\t \n"), (6, "word"), (7, "word"), (8, "12 34 ... !!"),
    (9, "Ünï cödé ärë hïër ünd dört " * 4), (10, ("one two three four five six seven eight nine ten " * 2000).strip()),
    (11, LONG_LINE + "\n" + LONG_LINE), (12, "<|endoftext|> is text  here"), (None, "no id at all here"), (None, None),
    (13, "repeated row text"), (13, "repeated row text"), (14, LONG_LINE.replace("omega", "last"))]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", "s", len(t or ""), *["x"] * 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    if not Path(SF).exists():
        pytest.skip("no driver tables")
    return spark.read.parquet(f"{SF}/documents.parquet")
