"""A log of commits on any file system that Spark reads: entry n holds the whole state after n commits and appears at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Log:
    """Entries <root>/_log/<n>.json. Data that no entry names was never committed, whatever is left of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("_log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        place = self._path("_log")
        names = [s.getPath().getName() for s in (self._fs.listStatus(place) if self._fs.exists(place) else [])]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The number and state of a version, by default of the newest; (0, {}) before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, {}
        stream = self._fs.open(self._path(f"_log/{version:012d}.json"))
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> int:
        """Makes state the version after the one it was made from; Conflict if that has a successor already."""
        place, part = self._path(f"_log/{after + 1:012d}.json"), self._path(f"_log/.{uuid.uuid4().hex}")
        if self._fs.exists(place):
            raise Conflict(str(place))
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._fs.rename(part, place):
            self._fs.delete(part, False)
            raise Conflict(str(place))
        return after + 1

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def folders(self, name: str) -> list[str]:
        place = self._path(name)
        return sorted(s.getPath().getName() for s in (self._fs.listStatus(place) if self._fs.exists(place) else []))
