import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """All documents of the smallest table, with the odd cases added."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    top = 10**6
    return [
        *rows,
        (None, None),
        (None, "x" * 300),
        (top, ""),
        (top + 1, rows[3][1]),
        (top + 1, rows[3][1]),
        (top + 2, "   \n"),
        (top + 3, "a b"),
        (top + 4, "A B"),
        (top + 5, "y" * 100_000),
        (top + 6, (rows[5][1] or "") + " more"),
        (top + 7, "Ça été 東京 \U0001f600 " * 30),
    ]


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows, dealt over some partitions, with columns whose names could clash."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).repartition(3).withColumn("block", F.lit("x")).withColumn("key", F.lit(None).cast("int")).withColumn("_id", F.lit(0.5))
