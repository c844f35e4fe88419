"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, shards.

Each stage works on all that the one before it kept; its result is written as Parquet and read again. For every stage: an empty
table gives an empty result; other columns of docs go along unchanged, whatever their names; repeated rows are rows of their own
(copies of each other in near_duplicates, which keeps one).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.decontaminate import contaminated, decontaminate
from tallyspark.llm.jaccard import SMALL, similar_components
from tallyspark.llm.mixing import mix
from tallyspark.llm.outliers import estimates, judged_texts, statistics
from tallyspark.llm.sharding import assign_shards
from tallyspark.llm.store import forget, is_small, table, written

#: The byte limit of a shard.
SHARD_BYTES = 16_000_000


#: The columns of documents that stages read.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with all columns that no stage reads under names of their own, so that none is that of an operator's, and the columns that bring them back."""
    names = {c: c if c in USED else f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor are robust outliers of their language and source. Null and empty texts have
    no words and fail the base rules; null languages and sources are values of their own."""
    rows, back = shielded(docs)
    return judged_texts(rows, estimates(written(statistics(rows.select("lang", "source", "text")), "counts"))).where("kept").select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group that five-word shingles connect at a similarity of 0.8: the one with the least id, nulls
    last, and of rows with the same id always the same one. Rows are told apart by where they stand in the input, so
    repeated rows are copies, and rows with one id and different texts are judged each by its own text."""
    rows, back = numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("_row").alias("row"))
    found = similar_components(rows.select(key.alias("_key"), "text"), "_key", width=5, p=80, q=100)
    gone = written(found.where("_key <> component_id").select(F.col("_key.row").alias("_row")), "copies")
    if is_small(gone, SMALL):
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select(back)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs (shielded) with _row, which tells each row apart and is the same whenever docs is read: a hash of the file's path (96 bits) and the
    row's number in it; if docs is not read from files, the number that it is written with. And the columns that bring docs back."""
    rows, back = shielded(docs)
    path = F.col("_metadata.file_path")
    row = F.struct(F.xxhash64(path).alias("a"), F.hash(path).alias("b"), F.col("_metadata.row_index").alias("n"))
    try:
        return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, rows.columns, strict=True)), row.alias("_row")), back
    except AnalysisException:
        return written(rows.withColumn("_row", F.struct(F.monotonically_increasing_id().alias("n"))), "numbered"), back


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; passages of test items too short a part of a document to condemn it are cut. Null and
    empty texts have no words and stay as they are; without test items everything stays."""
    rows, back = shielded(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), cut=True).where(~contaminated())
    text = F.coalesce("clean_text", "text")
    return found.withColumns({"text": text, "n_chars": F.when(F.col("clean_text").isNull(), F.col("n_chars")).otherwise(F.length("clean_text").cast("long"))}).select(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the tempered shares of sources, languages and topics. Rows with equal keys are drawn
    alike; null keys, sources and languages count as empty ones."""
    rows, back = shielded(docs)
    return mix(rows).where("sampled").select(back)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document. Null texts have no bytes; rows with equal or null keys share a shard unless they exceed the
    limit together; a row over the limit has a shard of its own."""
    return assign_shards(docs.select("doc_id", "text"), limit=SHARD_BYTES).select("doc_id", "bytes", "shard", "depth", "shard_bytes")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: SQL expresses neither the robust estimates nor the raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
