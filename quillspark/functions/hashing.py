"""Keyed hashes that rank rows the same way in every run."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_rank(seed: str | int, *keys: Column | str) -> Column:
    """A 32-digit hexadecimal rank of the keys under a seed; order by it, then by the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def blake2b_fraction(seed: int, key: Column | str) -> Column:
    """A fraction in [0, 1): the 8-byte blake2b of 'seed:key' as a big-endian integer over 2**64."""

    @F.arrow_udf("double")
    def fraction(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "big") / 2**64 for k in keys.to_pylist()], pa.float64())

    return fraction(key)


def blake2b_rank(prefix: str, key: Column | str) -> Column:
    """The 8-byte blake2b of 'prefix:key' in hexadecimal; its order is that of the integer."""

    @F.arrow_udf("string")
    def rank(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else hashlib.blake2b(f"{prefix}:{k}".encode(), digest_size=8).hexdigest() for k in keys.to_pylist()], pa.string())

    return rank(key)


def cache_key(url: Column | str) -> Column:
    """The first 32 hexadecimal digits of a URL's sha256."""
    return F.substring(F.sha2(F.col(url) if isinstance(url, str) else url, 256), 1, 32)


def accession_of(path: Column) -> Column:
    """The accession number in the stem of an archive path."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
