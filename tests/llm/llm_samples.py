"""Helpers of the training-data tests."""

import pytest

from pyspark.sql import functions as F

SF_CHECK = "/root/testdata/sf0.01"

WORDS = ("amber basin cedar delta ember fjord grove haven islet jetty knoll lagoon meadow nectar orchard "
         "prairie quarry ridge summit tundra upland valley willow yonder zephyr").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) with an extra column named like results."""
    def make(rows, schema="doc_id bigint, text string"):
        df = spark.createDataFrame(rows, schema)
        return (df.withColumn("ids", F.lit("x")).withColumn("kept", F.lit("y")).withColumn("_gone", F.lit("z"))
                .withColumn("_language", F.lit("w")).withColumn("component_id", F.lit("v")))
    return make
