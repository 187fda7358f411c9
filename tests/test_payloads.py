"""Payloads out of answers: how often an answer is worked out."""

from pyspark.sql import functions as F

from quarry.functions import loose_json as J


def test_payload_is_worked_out_once(spark):
    """An answer is cut into tokens for itself and for what is fenced in it, not again for each field."""
    df = spark.createDataFrame([("x {\"text\": \"a\"}",)], "raw string").select(J.page_payload(F.col("raw"), F.lit(1)).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 2
    assert df.first().p.text == "a"
