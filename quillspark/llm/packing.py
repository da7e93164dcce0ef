"""Best-fit packing of token pieces into sequences of a fixed length.

Documents are encoded in an Arrow function to piece descriptors (start, length, checksum), never to token rows. The
descriptors are dealt round robin into groups of about GROUP documents, and each group streams its pieces, in the order of a
hash, through bounded-space online best fit: OPEN bins at most are open, found through a bitset keyed by free space; when
one more is needed, the fullest closes. In that random order the bound costs about half a percent of the least number of
sequences, as what closes is nearly full.

Defined results: null and empty texts are the end id alone; a very long text is cut into whole sequences and a rest; equal
pieces tie by any order, each is placed once; repeated rows are packed once each; an empty table gives an empty result; other
input columns are dropped, so none can clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, vocabulary_path
from .encoding import token_ids

#: Bins that may be open at once in a group, and documents to a group.
OPEN = 128
GROUP = 16384

_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_NAMES = ["piece", "start", "length", "ids_crc32"]


def pieces(text: Column | str, path: str, size: int, end_id: int) -> Column:
    """The pieces of each text: ids plus end_id, cut every size ids."""

    @F.arrow_udf(_PIECES)
    @lean
    def cut_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        end = np.array([end_id], dtype="<u4")
        for column in batches:
            totals, sums = [], []
            for ids in token_ids(column, path):
                totals.append(len(ids) + 1)
                whole = np.concatenate([ids.astype("<u4"), end])
                sums += [zlib.crc32(whole[a : a + size]) for a in range(0, len(whole), size)]
            total = np.array(totals, dtype=np.int64)
            count = -(-total // size)
            bounds = np.concatenate([[0], np.cumsum(count)])
            piece = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
            start = piece * size
            length = np.minimum(np.repeat(total, count) - start, size)
            rows = pa.StructArray.from_arrays([pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], _NAMES)
            yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)

    return cut_up(text)


def best_fit(lengths: Iterable[int], size: int, most_open: int = OPEN) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length of a stream, by bounded-space online best fit.

    free has bit f set if some open bin has f free tokens; stacks holds those bins. The lowest set bit at or above a
    length is the best fit. A bin without room closes; when most_open bins are open, the one with the least free space does.
    """
    free, stacks, n_open, n_bins = 0, [[] for _ in range(size + 1)], 0, 0
    for length in lengths:
        fitting = free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            at = stacks[space].pop()
            if not stacks[space]:
                free &= ~(1 << space)
        else:
            if n_open == most_open:
                least = (free & -free).bit_length() - 1
                stacks[least].pop()
                if not stacks[least]:
                    free &= ~(1 << least)
                n_open -= 1
            at, space, n_bins, n_open = n_bins, size, n_bins + 1, n_open + 1
        yield at, size - space
        if left := space - length:
            stacks[left].append(at)
            free |= 1 << left
        else:
            n_open -= 1


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = 4096, end_id: int = 1, group: int = GROUP, most_open: int = OPEN) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    n_groups = max(1, math.ceil(docs.count() / group))
    found = (
        docs.select(F.col(key).alias("_key"), pieces(F.col(text), path, size, end_id).alias("_p"))
        .select("_key", F.inline_outer("_p"))  # each has a piece; inline's filter of empty ones would encode all texts twice, in two workers
        .repartition(n_groups)
        .sortWithinPartitions(F.xxhash64("_key", "piece", "ids_crc32"), "_key", "piece", "ids_crc32")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []

        def lengths() -> Iterator[int]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from batch.column("length").to_pylist()

        seq, offset = [], []
        for at, off in best_fit(lengths(), size, most_open):
            seq.append(base + at)
            offset.append(off)
            if len(seq) == waiting[0].num_rows:
                yield done(waiting.pop(0), seq, offset)
                seq, offset = [], []

    def done(batch: pa.RecordBatch, seq: list[int], offset: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = found.mapInArrow(place, f"_key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("_key", key)
