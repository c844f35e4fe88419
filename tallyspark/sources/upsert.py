"""A keyed table of hash partitions: an upsert rewrites only partitions in which a row really changes, and commits them together.

The log names, for each partition, the folder that holds it now. Readers of a version are never disturbed; a batch that changes
nothing writes no file and no commit, and one that a stream repeats after a failure is known by its number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Log


class KeyedTable:
    """Rows with one row a key (keys: never null) under root.

    content: the columns whose change makes a row a changed one (by default all of a batch but the keys); derived columns, and
    columns outside of content, are taken from the batch only when its row changes. partitions is fixed when the table is made."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], partitions: int = 64):
        self.spark, self.keys, self.log = spark, keys, Log(spark, root)
        self.partitions = self.log.read()[1].get("partitions", partitions)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        wanted = [b for b in state.get("parts", {}) if buckets is None or int(b) in buckets]
        if not state.get("schema"):
            return None
        schema = T.StructType.fromJson(state["schema"])
        by_folder: dict[str, list[str]] = {}
        for b in wanted:
            by_folder.setdefault(state["parts"][b], []).append(b)
        if not by_folder:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.log.root}/data/{folder}/_bucket={b}" for folder, bs in sorted(by_folder.items()) for b in bs]
        return self.spark.read.schema(schema).parquet(*paths)

    def table(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, by default of the newest; None before the first."""
        return self._read(self.log.read(version)[1])

    def upsert(
        self, batch: DataFrame, newest: list[Column] | None = None, content: list[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None, delete_missing: bool = False, source: str = "", epoch: int | None = None
    ) -> dict[str, int]:
        """Takes in the batch and says how many rows were new or changed, how many went, and how many partitions were rewritten.

        newest: of several rows of a key the one counts that is greatest in these columns (by default, by its digest). derive adds columns to changed rows only,
        such as their embedding. With delete_missing keys that the batch lacks go. (source, epoch): a batch of a stream; one that is not newer than what
        the source has committed is left out. Only the changed partitions' numbers, at most `partitions` of them, come to the driver.
        """
        version, state = self.log.read()
        nothing = {"changed": 0, "deleted": 0, "rewritten": 0}
        if epoch is not None and epoch <= state.get("epochs", {}).get(source, -1):
            return nothing
        content = content or [c for c in batch.columns if c not in self.keys]
        digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        order = F.struct(*newest) if newest else digest
        each = batch.withColumns({"_digest": digest, "_order": order})
        picked = each.groupBy(*self.keys).agg(F.max_by(F.struct(*(c for c in each.columns if c not in (*self.keys, "_order"))), "_order").alias("r")).select(*self.keys, "r.*")
        picked = picked.withColumn("_bucket", self._bucket())
        now = self._read(state)
        if now is None:
            changed, gone = picked, None
        else:
            held = now.select(*self.keys, F.col("_digest").alias("_held"))
            changed = picked.join(held, self.keys, "left").where(~F.col("_digest").eqNullSafe(F.col("_held"))).drop("_held")
            gone = held.join(picked.select(*self.keys), self.keys, "left_anti").select(*self.keys, self._bucket().alias("_bucket")) if delete_missing else None
        counts = {r[0]: r[1] for r in changed.groupBy("_bucket").count().collect()}
        lost = {r[0]: r[1] for r in gone.groupBy("_bucket").count().collect()} if gone is not None else {}
        touched = sorted({*counts, *lost})
        if not touched:
            return nothing
        fresh = derive(changed) if derive else changed
        rows = [fresh]
        if now is not None:
            kept = self._read(state, touched).join(changed.select(*self.keys), self.keys, "left_anti")
            if gone is not None:
                kept = kept.join(gone.select(*self.keys), self.keys, "left_anti")
            rows.append(kept.withColumn("_bucket", self._bucket()))
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        folder = uuid.uuid4().hex
        merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.log.root}/data/{folder}")
        written = {int(n.removeprefix("_bucket=")) for n in self.log.folders(f"data/{folder}") if n.startswith("_bucket=")}
        parts = {b: f for b, f in state.get("parts", {}).items() if int(b) not in touched} | {str(b): folder for b in written}
        epochs = state.get("epochs", {}) | ({source: epoch} if epoch is not None else {})
        self.log.commit(version, {"partitions": self.partitions, "parts": parts, "schema": merged.drop("_bucket").schema.jsonValue(), "epochs": epochs})
        return {"changed": sum(counts.values()), "deleted": sum(lost.values()), "rewritten": len(touched)}

    def sink(self, source: str, **options) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: each batch of a stream once, also if it is repeated after a failure."""

        def write(batch: DataFrame, epoch: int) -> None:
            self.upsert(batch, source=source, epoch=epoch, **options)

        return write

    def sweep(self, keep: int = 2) -> int:
        """Deletes folders that neither of the newest versions names, such as those of writers that were killed; their number. Not while a writer is at work."""
        used = {f for v in self.log.versions()[-keep:] for f in self.log.read(v)[1]["parts"].values()}
        old = [f for f in self.log.folders("data") if f not in used]
        for f in old:
            self.log.delete(f"data/{f}")
        return len(old)
