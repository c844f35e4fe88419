"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
#: Removes a query's shuffle files when it ends; what is written is read again, not computed again.
_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
#: Rows that go to Python at once, which bounds the memory beside the heap.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
BATCH_ROWS = 2000
#: Letters of a plan's text, which the driver keeps of every query (of long plans it would be megabytes).
_PLAN = ("spark.sql.maxPlanStringLength", "2000")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a folder of this machine is set if all tasks run on it
    (a local master); a cluster without the setting is an error, as its machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(path: str) -> None:
    spark = _written.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session may have ended; what is left is in the shared folder
            pass


atexit.register(_clean)


def written(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder (in folders by a column, if asked for) and read back: later readers do not depend on its lineage, and no
    executor holds the only copy. Shuffle files of the query go when it is written, the table with forget() or when the
    process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyspark/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, v) for k, v in (_CLEANUP, _BATCH)}
    before[_PLAN[0]] = spark.conf.get(_PLAN[0])
    spark.conf.set(*_PLAN)
    spark.conf.set(_CLEANUP[0], "true")
    spark.conf.set(_BATCH[0], str(min(BATCH_ROWS, int(before[_BATCH[0]]))))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, not even a frame that is still to be computed."""
    for frame in frames:
        _remove(frame._written_at)


def spread(rows: float, per_part: float, spark: SparkSession) -> int:
    """A number of partitions for so many rows (or bytes), at least the session's number of shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part), 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes (as JSON) up to which a table is broadcast; what is larger is joined with salted keys.
SMALL_BYTES = 32_000_000


def is_small(df: DataFrame, most: int) -> bool:
    """Whether all rows together take so many bytes at most, as JSON."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] <= most


def left_join_small(rows: DataFrame, small: DataFrame, left: str, right: str, salts: int = 64) -> DataFrame:
    """rows left-joined to a table with one row a key, of which some keys may hold most of rows. The table is written and its
    size checked: up to SMALL_BYTES it is broadcast and rows stay in place; beyond that each of its rows is repeated for every
    salt and rows are dealt by key and salt, so that no task gets a whole hot key."""
    small = written(small, "small")
    if is_small(small, SMALL_BYTES):
        return rows.join(F.broadcast(small), F.col(left) == F.col(right), "left")
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_of"))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return dealt.join(salted, (F.col(left) == F.col(right)) & (F.col("_salt") == F.col("_salt_of")), "left").drop("_salt", "_salt_of")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns whose names clash, whatever their case, with the names that an operator adds."""
    low = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def as_bytes(c: str):
    return F.col(c).cast("string").cast("binary")
