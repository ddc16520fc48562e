"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \x09-\x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: One word, as a pattern for Java and Python.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the one that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in a local session, as in tests, is a temporary folder made; on a cluster it must be set.
    """
    key = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/weftgraph-{key}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _OWN_FOLDERS[key]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes read the files, so the work above runs once and an executor lost afterwards costs nothing. The files
    stay until ``discard`` or ``release``, as results read them lazily.
    """
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), *_SCRATCH, uuid.uuid4().hex])
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


_SCRATCH: list[str] = []


def written(df: DataFrame) -> str:
    """Writes ``df`` to the shared folder, outside of any scratch, and gives the path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end: for work whose result is written elsewhere before that."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}")
    path = "/".join([shared_folder(spark), *_SCRATCH])
    try:
        yield
    finally:
        _SCRATCH.pop()
        delete(spark, path)


_LEFT: dict[str, list[str]] = {}


@contextlib.contextmanager
def stage_scratch(spark: SparkSession, docs: DataFrame, final: bool = False) -> Iterator[None]:
    """As ``scratch`` for a stage whose result is written after it returns: its tables are deleted when a later stage begins.

    A ``final`` stage's tables are not. Others stay as long as the ``docs`` of later stages read them, that is, where a result was handed on without being written.
    """
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    read = docs.inputFiles() if left else []
    for path in list(left):
        name = path.rsplit("/", 1)[1]
        if not any(name in f for f in read):
            delete(spark, path)
            left.remove(path)
    if final:
        yield
        return
    _SCRATCH.append(f"stage-{uuid.uuid4().hex}")
    left.append("/".join([shared_folder(spark), *_SCRATCH]))
    try:
        yield
    finally:
        _SCRATCH.pop()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(written: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    delete(written.sparkSession, written._written_at)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; its unread results are lost."""
    delete(spark, shared_folder(spark))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a number for each row in the column ``name``, so that it stays the same in all later passes."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


#: Rows of an Arrow batch to and from Python: whole texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def session_for_texts(spark: SparkSession) -> None:
    """Bounds Arrow batches in this session; called by the queries and stages, whose rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


_STATE: dict[Any, Any] = {}


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks. One operator's state is held at a time, so that the stages of a
    pipeline, which run in the same workers, do not add up."""
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can, free memory goes back at once
            ctypes.CDLL(None).malloc_trim(0)
        _STATE[key] = build()
    return _STATE[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning: its remainder is the given one, or it has no id to tell by."""
    return F.coalesce(digest_remainder(id_col, modulus) == remainder, F.lit(True))


def fold_sample(df: DataFrame, order_cols: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows in an order that depends on the rows alone (TakeOrderedAndProject)."""
    return df.orderBy(*[F.xxhash64(F.col(c)) for c in order_cols], *order_cols).limit(rows)


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text; bytes.split() splits at exactly the six characters of WORD_SPACE."""
    return data.split()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over uint64 arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
