import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents-like table with extra columns whose names clash with the operators' own."""
    def of(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema)
        return df.select("*", F.lit("x").alias("rid"), F.lit(1).alias("key"), F.lit("z").alias("score"), F.lit(2).alias("n"), F.lit("c").alias("component"))
    return of
