"""The newest fetch of each key as a stream: late corrections within a window replace what was known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shaping import latest_per


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def newest_first(stream: DataFrame, keys: list[str], fetched: str, late: str = "7 days") -> DataFrame:
    """Drops what arrives later than the window after the newest fetch, and repeats of the same fetch."""
    return stream.withColumn(fetched, F.col(fetched).cast("timestamp")).withWatermark(fetched, late).dropDuplicatesWithinWatermark([*keys, fetched])


def upsert_into(path: str, keys: list[str], fetched: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in a folder of versions. A batch that is run again after a
    failure writes the same version again."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = sorted(int(s.getPath().getName()[1:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("v"))
        before = [v for v in known if v < epoch + 1]
        rows = batch if not before else batch.unionByName(spark.read.parquet(f"{path}/v{before[-1]}"))
        latest_per(rows, keys, fetched).write.mode("overwrite").parquet(f"{path}/v{epoch + 1}")

    return write


def current(spark: SparkSession, path: str, epochs: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{epochs}")


def daily_counts(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Events a day, each day final once the watermark has passed it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")
