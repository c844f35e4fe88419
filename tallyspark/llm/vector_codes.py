"""Vector compression by codebooks of parts, in exact integers, with float32 matrix products as a screen.

Vectors become integers and are cut into parts; every part position has a codebook that some rounds of assignment and mean refine.
The distances of all parts to all entries are first bounded by one float32 matrix product a part position: its rounding error has a
rigorous bound (see _assign), so every entry has an interval that holds its true distance. An entry whose interval ends before
all others begin is the nearest; where intervals overlap, the entries concerned are evaluated again in int64, and ties go to the lower index.

A round is one pass over the table: tasks send the sums of their parts by entry, which Spark adds up; what comes to the driver are
the entries themselves, whose number is fixed (parts x entries x positions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SMALL_BYTES, is_small, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Scaled components up to which int64 holds every sum of squares here.
LARGEST = 1 << 26


def _assign(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the nearest row of book for each row of x, both int64; ties to the lower index.

    With u = 2**-24 and m positions, converting both sides to float32 and summing m products in any order, fused or not, is off by
    at most g |x||c| where g = (m + 2) u / (1 - (m + 2) u). Norms and the final sum are rounded in float64, for which a share of
    2**-40 more is allowed.
    """
    m = x.shape[1]
    if not m:
        return np.zeros(len(x), np.int64)
    g = (m + 2) * 2.0**-24 / (1 - (m + 2) * 2.0**-24)
    dot = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    squares = (book * book).sum(1).astype(np.float64)
    norms = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(squares)
    middle = squares - 2 * dot
    width = 2 * g * norms + (squares + 2 * np.abs(dot) + 2 * g * norms) * 2.0**-40
    near = middle - width <= (middle + width).min(1)[:, None]
    best = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        r, c = np.nonzero(near[open_rows])
        exact = np.full((len(open_rows), len(book)), np.iinfo(np.int64).max)
        odd = x[open_rows[r]] - book[c]
        exact[r, c] = (odd * odd).sum(1)
        best[open_rows] = exact.argmin(1)
    return best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one size as rows, zeros after their ends up to a multiple of PARTS."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size) if size else np.zeros((len(column), 0), np.int64)
    return np.pad(flat, ((0, 0), (0, -size % PARTS)))


def _sums(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """Of each part position and entry: number and sums by position of the parts that the entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            for j, x in enumerate(np.split(_matrix(b.column(0), size), PARTS, axis=1)):
                near = _assign(x, books[j])
                n[j] += np.bincount(near, minlength=len(n[j]))
                np.add.at(total[j], near, x)
        rows = [(j, e, int(n[j][e]), total[j][e].tolist()) for j in range(PARTS) for e in np.flatnonzero(n[j]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "total"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    each = vectors.select("v").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    at = each.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
    return at.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def _codes(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """vectors with code and error in place of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, np.int64)
            for j, x in enumerate(np.split(_matrix(b.column(2), size), PARTS, axis=1)):
                near = _assign(x, books[j])
                code[:, j] = near
                odd = x - books[j][near]
                error += (odd * odd).sum(1)
            hexed = code.tobytes().hex()
            codes = [hexed[k : k + 2 * PARTS] for k in range(0, len(hexed), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error) and the final codebook of each part position.

    Rows whose vector is null or holds null or non-finite components are left out. Component x counts as floor(4096 x); one over 2**26
    then is an error, as sums of squares would not fit. Vectors of another length than most have (of equally frequent lengths
    the longest) cannot be compared and are left out too; a length that is no multiple of 8 counts as filled up with zeros. The 16
    rows of least key (nulls last; of equal keys the least vector) are the first entries; fewer rows are fewer entries.
    Repeated rows count each; an empty table gives an empty result and empty codebooks. Other columns are not carried, so their names do not matter.
    """
    number = F.col("v0")
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v0")).where(number.isNotNull() & ~bad)
    whole = F.transform(number, lambda x: F.when(F.abs(x) * SCALE > LARGEST, F.raise_error(F.lit("a component is too large"))).otherwise(F.floor(x * SCALE)).cast("int"))
    vectors = written(rows.select("id", "label", whole.alias("v")), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    size = lengths[0] if lengths else 0
    vectors = vectors.where(F.size("v") == size)
    first = [r[0] for r in vectors.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(ENTRIES).collect()]
    seeds = np.array(first, np.int64).reshape(len(first), size)
    books = np.split(np.pad(seeds, ((0, 0), (0, -size % PARTS))), PARTS, axis=1)
    for _ in range(ROUNDS if len(seeds) and size else 0):
        for part, entry, at, n, x in _sums(vectors, books, size).collect():
            books[part][entry, at] = x // n
    if not len(seeds):
        return df.sparkSession.createDataFrame([], _empty(vectors)), books
    return _codes(vectors, books, size), books


def _empty(vectors: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and position, parted by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error (the errors of all rows with the label, nulls together) and codebooks_sha256; see compress()."""
    found, books = compress(df, key, vector, label)
    found = written(found, "codes")
    sums = written(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    small = F.broadcast(sums) if is_small(sums, SMALL_BYTES) else sums
    return found.join(small, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
