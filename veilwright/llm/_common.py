"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Seconds between two collections of the driver's garbage.
COLLECT = 2.0
_collected = 0.0
#: Rows that a task reads at least of a frame that cut_small() wrote.
ROWS_EACH = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where that is unset.

    Own folders are for local masters alone: on a cluster the executors could not see them.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veilwright-")
        atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that nothing above is computed again.

    What was shuffled for them is not needed any more: a collection of the driver's garbage, at most
    every COLLECT seconds, lets Spark's cleaner remove its files, and keeps finished plans from piling up.
    """
    global _collected
    spark = frame.sparkSession
    checkpoint_dir(spark)
    done = frame.checkpoint(eager=True)
    if time.monotonic() - _collected > COLLECT:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    return done


def cut_small(frame: DataFrame) -> tuple[DataFrame, int]:
    """cut() for rows of no great size, and their number.

    Where a frame has few rows in many partitions, a task reads several of them: else each later
    exchange costs a task and files of its own for every one, however little is in it.
    """
    seen = Observation()
    done = cut(frame.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    tasks = max(frame.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_EACH))
    return done.coalesce(tasks) if 4 * tasks <= done.rdd.getNumPartitions() else done, n


def packed(frame: DataFrame, columns: list[str], name: str = "_own") -> Column:
    """The columns in one struct, so that no name of theirs meets an operator's own."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in columns)).alias(name) if columns else F.lit(None).cast("int").alias(name)


def unpacked(columns: list[str], name: str = "_own") -> list[Column]:
    """What packed() holds, column by column."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def release() -> None:
    """Gives memory back at a task's end: the worker process stays, idle, beside the next stage's."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have none
        pass


def map_rows(frame: DataFrame, columns: list[str], added: pa.Schema, types: str, make: Callable[[], Callable], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that Python computes row by row from `columns`, batch by batch.

    make() is called once in each task and gives a function from the values of `columns` to a
    tuple of the added values. Input columns of the same names as added ones are replaced.
    """
    import pyspark.sql.types as T

    new = T._parse_datatype_string(types)
    fresh = {f.name for f in new.fields}
    kept = [f for f in frame.schema.fields if f.name not in fresh and f.name not in drop]
    schema = T.StructType([*kept, *new.fields])
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            # a batch of long texts is answered in parts
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = [f(*row) for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)]
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                for i, field in enumerate(added):
                    arrays.append(pa.array([v[i] for v in values], type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])
                del values, arrays, part
        release()

    return frame.mapInArrow(run, schema)
