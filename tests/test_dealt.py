"""Questions of one file are read in all tasks."""

from pyspark.sql import functions as F

from tallyspark.operators.entities import spans_of


def test_questions_of_one_file_are_dealt(spark, tmp_path):
    spark.range(4000).select("id", F.concat(F.lit("How did Ana Moss "), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/q")
    runs = spans_of(spark.read.parquet(f"{tmp_path}/q"), "id", "text")
    rows = runs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 4000 * 14 and len(rows) > 1 and max(r["count"] for r in rows) < 4000 * 14 * 0.6
