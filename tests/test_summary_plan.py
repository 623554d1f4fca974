"""The plan of the summary of endpoints: the paired cells are made once."""

from pyspark.sql import functions as F

from tidewright.operators import endpoints as E
from tidewright.plans.views import cells


def test_cells_are_made_once(spark):
    found = cells(spark, "/root/testdata/sf0.001")
    df = E.endpoint_summary(found, spark.createDataFrame([], "model string"), 20)
    made = spark.sparkContext.accumulator(0)
    marked = F.udf(lambda m: made.add(1) or m, "string")(F.col("model"))
    n = found.count()
    assert E.endpoint_summary(found.withColumn("model", marked), spark.createDataFrame([], "model string"), 20).count() == df.count()
    assert 0 < n == made.value
    spark.catalog.clearCache()
