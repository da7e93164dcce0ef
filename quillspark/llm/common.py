"""Shared pieces of the training-data operators: lineage cuts, word splitting, vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes or folds bytes so that bytes.split() yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: What a worker keeps between tasks: the state of the operator that it last worked for.
_RESIDENT: dict = {}


def trim() -> None:
    """Gives unused memory of this process back."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, kept under key until a worker needs another key's, so states never add up in a worker."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        trim()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def lean(of: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The function of an iterator of batches, with the worker's unused memory given back at the end of its task."""

    @functools.wraps(of)
    def run(batches: Iterator) -> Iterator:
        yield from of(batches)
        trim()

    return run


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, so lost executors cost no recomputation of it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a compressed Parquet table in the shared folder and read back: the cut for wide or reused rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that texts go to Python in. It holds a batch, its copy in the JVM and what is made of it small.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python in batches of BATCH bytes, unless it has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([stem], (f"{stem}_{i}" for i in itertools.count())) if n.lower() not in have)


def with_results(df: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    """df plus the fields of struct; an input column of the same name as a result gives way to the result."""
    bounded_batches(df.sparkSession)
    tmp = fresh(df, "_result")
    out = df.withColumn(tmp, struct)
    taken = {n.lower() for n in names}
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[F.col(f"{tmp}.{n}").alias(n) for n in names])


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column _row beside the given columns, so that no names clash; restored() undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def restored(found: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns held in _row, with new ones in place of some."""
    return found.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def folded_words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after A-Z are lowered, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def by_bytes(column: pa.Array, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, list[str | None]]]:
    """(first index, texts) in runs of about most UTF-8 bytes and at most rows texts. Only one run at a time is held as strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(ends, ends[a] - sizes[a] + most, side="right"))
        b = min(max(b, a + 1), a + rows)
        yield a, column.slice(a, b - a).to_pylist()
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; QUILLSPARK_TOKENIZERS may name another folder that holds them."""
    if folder := os.environ.get("QUILLSPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_bucket(column: Column, modulus: int) -> Column:
    """crc32(column as text) mod modulus; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
