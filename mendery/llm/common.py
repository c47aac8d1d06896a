"""What the operators share: table access, shared storage, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable: the cluster's folder, else (unset, as in tests) one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """`df` stored in the shared checkpoint folder, its lineage cut; survives the loss of executors."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are stored: it acts when their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 64):
    """Arrow batches of few rows for jobs run within, whose rows hold many texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """`df`, and no larger Arrow batches than this in its session: texts are long, and a batch is held as a whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return df


def crc_remainder(col: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def batches_of(rows: Iterator, chars: int):
    """Group (key, text) rows into lists of at most `chars` characters, one row at least."""
    held, size = [], 0
    for row in rows:
        n = len(row[-1])
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += n + 1
    if held:
        yield held


#: Rows of an Arrow batch that are Python objects at one time.
SLICE = 256


def arrow_rows(batches: Iterator, *names: str):
    """Rows of the named columns from Arrow batches, one at a time; null texts (the last name) are empty."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        for i in range(0, batch.num_rows, SLICE):
            for row in zip(*(batch.column(k).slice(i, SLICE).to_pylist() for k in at), strict=True):
                yield (*row[:-1], row[-1] or "")


def trim() -> None:
    """Give memory that isn't used back to the system; workers outlive the tasks of one operator."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def only(key, make):
    """The one large object that a worker keeps over its tasks: another key drops it."""
    if key not in _held:
        _held.clear()
        gc.collect()
        trim()
        _held[key] = make()
    return _held[key]


def trimmed(run):
    """A function for mapInArrow that keeps nothing: it starts without the object of only() and trims memory at its end."""

    def inner(batches):
        only("none", dict)
        try:
            yield from run(batches)
        finally:
            trim()

    return inner
