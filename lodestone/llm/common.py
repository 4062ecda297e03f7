"""Shared pieces of the training-data operators: scratch tables, batching, ASCII folding."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import string
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.sources.files import checkpoint_root

#: Bytes of text that a Python worker holds unpacked at once.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker; a larger row has a batch of its own.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: The white space that the word and line operators know.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def prepare_workers(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, and let them import this package from where the driver has it.

    Spark bounds a batch by rows alone unless told otherwise, and ten thousand long texts are no small
    batch. A limit that the session has stays. Without the path a local session finds the package only if
    it was started in its folder; on a cluster the package comes to the executors in the usual ways
    (installed there, or by --py-files), and the path changes nothing.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    Lazy results read some of them, so an operator drops those that its result does not need, and the
    driver's JVM deletes the rest when it ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        prepare_workers(spark)
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count, self.last, self.tables = 0, "", []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        self.last = f"{self.count:03d}-{name}"
        path = f"{self.path}/{self.last}"
        df.write.parquet(path)
        if not self.tables:
            folder, files = self.files()
            files.deleteOnExit(folder)
        self.tables.append(self.last)
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self, name: str = ""):
        """A table's path, or that of all, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str = "") -> None:
        """Delete one table, by what `last` was after it was written, or all of them."""
        path, files = self.files(name)
        files.delete(path, True)
        self.tables = [x for x in self.tables if name and x != name]

    def keep(self, *names: str) -> None:
        """Delete all tables but the last one written under each of these names."""
        last = {x.partition("-")[2]: x for x in self.tables}
        for table in self.tables:
            if table not in {last.get(x) for x in names}:
                self.drop(table)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of ASCII, the most, take the byte-wise path of lower()."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose `column` holds about `most` bytes; a longer value has a slice of its own.

    Arrow's pool keeps what it has had for a batch; it is given back after each.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def clear_prefix(df: DataFrame) -> str:
    """`__`, or more underscores if a column begins with those: what operators put before names they add."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null text becomes empty.

    Ids are integers of any width, null among them; operators that hand rows to Python take no others.
    """
    prepare_workers(df.sparkSession)
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_held: list = [None, None]


def let_go() -> None:
    """Drop what held() has made. Workers serve stage after stage; those that need no heavy object begin with this."""
    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc have no such call
            ctypes.CDLL(None).malloc_trim(0)


def held(make, *key):
    """A heavy object of this process: made when first asked for, and let go when another one is."""
    if _held[0] != (make, key):
        let_go()
        _held[:] = [(make, key), make(*key)]
    return _held[1]


class Memo(dict):
    """A bounded memo of `make`: two generations, of which the older goes when the newer is full."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
