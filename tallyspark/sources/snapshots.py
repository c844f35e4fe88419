"""Immutable builds: a folder of Parquet tables with a manifest, published by swapping a pointer."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """The same for the same rows in any order: a sum of row hashes and a count."""
    rows = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
    h, n = rows.agg(F.coalesce(F.sum("h"), F.lit(0)), F.count("*")).first()
    return hashlib.sha256(f"{h}:{n}:{df.schema.simpleString()}".encode()).hexdigest()


def write_partitioned(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """One sorted run of files for each partition value; a partition too large for one task is cut into ranges."""
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(path)


def publish_copy(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes every table and checks that as many rows are read back."""
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
        if counts[name] != df.count():
            raise ValueError(f"{name}: {counts[name]} rows were written, not {df.count()}")
    return counts


def scope_seed(seed: DataFrame, games: DataFrame, keys: tuple[str, ...] = ("season", "season_type")) -> DataFrame:
    """The seed's rows whose season is in the games; rows without a season stay."""
    blank = F.col(keys[0]).isNull() | (F.trim(keys[0]) == "")
    return seed.where(~blank).join(games.select(*keys).distinct(), list(keys), "left_semi").unionByName(seed.where(blank))


class Snapshots:
    """Builds under a root on a file system that the driver sees; `current` names the published one."""

    def __init__(self, spark: SparkSession, root: str | Path, keep: int = 7):
        self.spark, self.root, self.keep = spark, Path(root), keep
        self.root.mkdir(parents=True, exist_ok=True)

    def build(self, name: str, tables: dict[str, DataFrame], as_of: str) -> Path:
        path = self.root / name
        if path.exists():
            raise FileExistsError(f"{name} exists, and builds do not change")
        counts = publish_copy(tables, str(path))
        files = {str(p.relative_to(path)): [p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()] for p in sorted(path.rglob("*.parquet"))}
        (path / "manifest.json").write_text(json.dumps({"name": name, "as_of": as_of, "rows": counts, "files": files}, indent=1))
        return path

    def check(self, name: str) -> None:
        """Raises unless every file is as the manifest says."""
        path = self.root / name
        for f, (size, digest) in json.loads((path / "manifest.json").read_text())["files"].items():
            p = path / f
            if not p.exists() or p.stat().st_size != size or hashlib.sha256(p.read_bytes()).hexdigest() != digest:
                raise ValueError(f"{name}: {f} is not as it was built")

    def published(self) -> str | None:
        p = self.root / "current"
        return p.read_text().strip() if p.exists() else None

    def _point(self, name: str) -> None:
        part = self.root / "current.part"
        part.write_text(name)
        os.replace(part, self.root / "current")

    def names(self) -> list[str]:
        return sorted(p.parent.name for p in self.root.glob("*/manifest.json"))

    def publish(self, name: str) -> None:
        """Checks a build, points at it, and drops the oldest beyond those kept."""
        self.check(name)
        self._point(name)
        for old in [n for n in self.names() if n != name][: max(0, len(self.names()) - self.keep)]:
            shutil.rmtree(self.root / old)

    def rollback(self) -> str:
        """Points at the build before the published one."""
        now = self.published()
        before = [n for n in self.names() if now is None or n < now]
        if not before:
            raise ValueError("there is no earlier build")
        self.check(before[-1])
        self._point(before[-1])
        return before[-1]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.root / (self.published() or "") / name))
