"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import checkpoint_dir, table
from veilwright.llm.bpe import bpe_encode
from veilwright.llm.decontamination import decontaminate
from veilwright.llm.line_dedup import dedup_lines
from veilwright.llm.near_dedup import drop_near_duplicates
from veilwright.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs, keep=COLUMNS).filter("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go from all but the last of these; all documents stay."""
    found = dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text"), "lang", "source")
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return drop_near_duplicates(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS, unnamed=True).filter("NOT contaminated").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, with digests of the ids and of the decoded text."""
    coded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded", drop=("text",))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("minhash_near_dedup", near), ("decontamination", benchmark), ("bpe", encode)]

#: The covariance estimates of the quality rules are iterative: no SQL states the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written in the shared folder and read again.

    What a stage read is removed once its own rows are written; the last one's when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(""))
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(path(before), True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
