"""A backfill that can be killed at any moment and goes on where it was: units, in waves, each committed with its data or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Log

Fetch = Callable[[dict], str]
_DONE = "uid string, stage string, body string, error string"


class Backfill:
    """Units (uid, and whatever fetch needs) of several stages, under root.

    A wave is the units of a hash of their uid; its answers are written to a folder of their own, which the log then names. What a killed run
    has written without a commit is never read, so its wave is fetched again and no unit is in the table twice. Units that fail are
    committed with their error and tried again by the next run."""

    def __init__(self, spark: SparkSession, root: str, waves: int = 16):
        self.spark, self.waves, self.log = spark, waves, Log(spark, root)

    def _all(self) -> DataFrame:
        folders = self.log.read()[1].get("folders", [])
        if not folders:
            return self.spark.createDataFrame([], _DONE)
        return self.spark.read.schema(_DONE).parquet(*(f"{self.log.root}/data/{f}" for f in folders))

    def table(self, stage: str | None = None) -> DataFrame:
        """uid, stage and body of every unit that was fetched."""
        rows = self._all().where("error is null").drop("error")
        return rows if stage is None else rows.where(F.col("stage") == stage)

    def failures(self) -> DataFrame:
        """uid, stage and error of units that have failed and not been fetched since; the errors of one unit are its last wave's."""
        return self._all().where("error is not null").join(self.table().select("uid"), "uid", "left_anti").groupBy("uid", "stage").agg(F.max("error").alias("error"))

    def run(self, stages: dict[str, Callable[[Backfill], DataFrame]], fetch: Fetch, waves: int | None = None) -> dict[str, int]:
        """Fetches every unit that is not done and says how many were fetched, skipped and failed. stages: name -> plan, which may read table() of
        earlier stages; a plan that raises LookupError blocks its stage only. fetch is called on the executors, a unit at a time; its error is the unit's. waves: at most so many
        are committed (a run that ends early), by default all."""
        stats = {"fetched": 0, "skipped": 0, "failed": 0, "blocked": 0}
        left = waves
        for stage, plan in stages.items():
            try:
                units = plan(self).dropDuplicates(["uid"])
            except LookupError:
                stats["blocked"] += 1
                continue
            todo = units.join(self.table().select("uid"), "uid", "left_anti").withColumn("_wave", F.pmod(F.xxhash64("uid"), F.lit(self.waves)))
            sizes = {r[0]: r[1] for r in todo.groupBy("_wave").count().collect()}
            stats["skipped"] += units.count() - sum(sizes.values())
            for wave in sorted(sizes):
                if left is not None and left <= 0:
                    return stats
                got, lost = self._commit(todo.where(F.col("_wave") == wave).drop("_wave"), stage, fetch)
                stats["fetched"] += got
                stats["failed"] += lost
                left = None if left is None else left - 1
        return stats

    def _commit(self, units: DataFrame, stage: str, fetch: Fetch) -> tuple[int, int]:
        def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for unit in b.to_dict("records"):
                    try:
                        rows.append((unit["uid"], stage, fetch(unit), None))
                    except Exception as e:
                        rows.append((unit["uid"], stage, None, f"{type(e).__name__}: {e}"[:500]))
                yield pd.DataFrame(rows, columns=["uid", "stage", "body", "error"])

        folder = uuid.uuid4().hex
        path = f"{self.log.root}/data/{folder}"
        units.mapInPandas(answers, _DONE).write.parquet(path)
        found = self.spark.read.schema(_DONE).parquet(path).agg(F.count(F.when(F.col("error").isNull(), 1)), F.count("error")).first()
        version, state = self.log.read()
        self.log.commit(version, {"folders": [*state.get("folders", []), folder]})
        return tuple(found)
