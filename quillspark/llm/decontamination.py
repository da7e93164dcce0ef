"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over every document's words.

The benchmark is read in blocks of at most BLOCK bytes of text (a longer item is split, with its windows kept whole), and one
block at a time is broadcast and indexed in arrays, so neither grows with the data. A benchmark of several blocks takes one pass
over the documents for each; passes write only the rows that are hit. Window hashes only propose: each hit is verified word by
word.

Defined results: null and wordless texts have no words, no hits and are not contaminated; very long texts are scanned whole;
null item ids mark words but are not listed; equal item ids count once; benchmark items without words never match; input columns
named like a result give way to it; repeated documents each get their row; empty tables give empty or hitless results.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, folded_words, fresh, held, lean, mix64, resident, restored, with_results, written

#: Bytes of benchmark text to a block. Its index takes some 20 times that in a worker, most of it for distinct words.
BLOCK = 8 << 20
_SCAN = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_SCAN_DDL = "struct<n_words:bigint,items:array<string>,starts:array<bigint>,ends:array<bigint>>"
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
#: An item, or a part of one: its id, its words, and how many windows begin in it (None: as many as fit, one if it is short).
Item = tuple[str | None, bytes, int | None]


class Index:
    """The windows of a block of items, by window length: sorted hashes, where in the items' words each begins, its items."""

    def __init__(self, items: list[Item], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _, _ in items]
        ids: list[int] = []
        groups: dict[int, list[tuple[int, int, int]]] = {}  # by width: (first word, windows, item)
        for k, (_, words, count) in enumerate(items):
            found = words.split()
            width = n if count is not None else min(n, len(found))
            if found:
                groups.setdefault(width, []).append((len(ids), len(found) - width + 1 if count is None else count, k))
            ids += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in found]
        self.words = np.array(ids, dtype=np.int64)
        self.tables = {width: self._table(width, *np.array(groups[width], dtype=np.int64).T) for width in sorted(groups)}

    def _table(self, width: int, first: np.ndarray, count: np.ndarray, item: np.ndarray) -> tuple:
        begin = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        owner = np.repeat(item, count)
        for seed in range(1, 1000):
            factors = mix64(np.arange(seed, seed + width, dtype=np.uint64)) | np.uint64(1)
            hashes = np.zeros(len(begin), dtype=np.uint64)
            for j in range(width):
                hashes += self.words[begin + j].astype(np.uint64) * factors[j]
            order = np.lexsort((owner, hashes))
            h, b = hashes[order], begin[order]
            same = np.flatnonzero(h[1:] == h[:-1])
            if all((self.words[b[same] + j] == self.words[b[same + 1] + j]).all() for j in range(width)):
                break  # windows of one hash are one window
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        once = np.concatenate([[True], (group[1:] != group[:-1]) | (owner[order][1:] != owner[order][:-1])])
        bounds = np.searchsorted(group[once], np.arange(group[-1] + 2))
        return h[new], b[new], factors, bounds, owner[order][once]

    def scan(self, texts: Sequence[str | None]) -> list[dict]:
        words = [folded_words(t) for t in texts]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(n_words + 1, out=starts[1:])
        ids = np.zeros(int(starts[-1]), dtype=np.int64)
        get = self.vocab.get
        for s, w in zip(starts.tolist(), words, strict=False):
            ids[s : s + len(w)] = [get(x, 0) for x in w]
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        edges = np.zeros(len(ids) + 1, dtype=np.int64)
        docs, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for width, (hashes, begins, factors, bounds, owners) in self.tables.items():
            if len(ids) < width:
                continue
            at = np.flatnonzero(unknown[width:] == unknown[:-width])
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(width):
                h += ids[at + j].astype(np.uint64) * factors[j]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            at, place = at[hit], place[hit]
            same = np.ones(len(at), dtype=bool)
            for j in range(width):
                same &= ids[at + j] == self.words[begins[place] + j]
            at, place = at[same], place[same]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            pair = np.unique(doc * len(hashes) + place)
            doc, place = pair // len(hashes), pair % len(hashes)
            n = bounds[place + 1] - bounds[place]
            docs.append(np.repeat(doc, n))
            items.append(owners[np.repeat(bounds[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        covered = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
        change = np.diff(covered)
        lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        of = np.searchsorted(starts, lo, side="right") - 1
        out = [{"n_words": int(n), "items": [], "starts": [], "ends": []} for n in n_words]
        for d, a, b in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True):
            out[d]["starts"].append(a - int(starts[d]))
            out[d]["ends"].append(b - int(starts[d]))
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], axis=1), axis=0)
        for d, k in pairs.tolist():
            if self.names[k] is not None:
                out[d]["items"].append(self.names[k])
        return out


def _parts(name: str | None, text: str, n: int, most: int) -> Iterator[Item]:
    """An item, or its parts of at most most bytes or one window; windows that cross a cut are the earlier part's."""
    words = folded_words(text)
    if len(text.encode()) <= most or len(words) <= n:
        yield name, b" ".join(words), None
        return
    a = 0
    while a <= len(words) - n:
        b, size = a, 0
        while b <= len(words) - n and (b == a or size < most):
            size += len(words[b]) + 1
            b += 1
        yield name, b" ".join(words[a : b + n - 1]), b - a
        a = b


def blocks(items: Iterator[tuple[str | None, str]], n: int, most: int) -> Iterator[list[Item]]:
    """Runs of items of at most most bytes of words (or one window more)."""
    run: list[Item] = []
    size = 0
    for name, text in items:
        for part in _parts(name, text, n, most):
            if run and size + len(part[1]) > most:
                yield run
                run, size = [], 0
            run.append(part)
            size += len(part[1])
    if run:
        yield run


def _scanned(column: pa.Array, index: Index) -> list[dict]:
    return [x for _, run in by_bytes(column, 1 << 18) for x in index.scan(run)]


def _scan(text: Column, block: Any, n: int) -> Column:
    name = uuid.uuid4().hex

    @F.arrow_udf(_SCAN_DDL)
    @lean
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = resident(name, lambda: Index(block.value, n))
        for column in batches:
            yield pa.array(_scanned(column, index), _SCAN)

    return scan(text)


def _digest(text: Column, block: Any, n: int) -> Column:
    name = uuid.uuid4().hex

    @F.arrow_udf(_DIGEST_DDL)
    @lean
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = resident(name, lambda: Index(block.value, n))
        for column in batches:
            yield pa.array([_one([x]) for x in _scanned(column, index)], _DIGEST)

    return scan(text)


_DIGEST = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("hit_items", pa.list_(pa.string())),
    ("hit_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
_DIGEST_DDL = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,hit_items:array<string>,hit_ranges:array<struct<start:bigint,end:bigint>>>"


def _one(parts: list[dict]) -> dict:
    """The scans of a document by all blocks as one: items by name, covered word ranges by union."""
    names = sorted({x for p in parts for x in p["items"]})
    merged: list[list[int]] = []
    for a, b in sorted(ab for p in parts for ab in zip(p["starts"], p["ends"], strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return {
        "n_words": parts[0]["n_words"], "n_hit": sum(b - a for a, b in merged), "n_items": len(names),
        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "hit_items": names,
        "hit_ranges": [{"start": a, "end": b} for a, b in merged],
    }


def _merged(scans: pa.Array) -> pa.Array:
    return pa.array([_one(parts) for parts in scans.to_pylist()], _DIGEST)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, share: int = 20, block_bytes: int = BLOCK) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), hit_items and
    hit_ranges (word ranges, end exclusive)."""
    context = docs.sparkSession.sparkContext
    kept = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    runs = blocks(((r.item, r.text) for r in kept.toLocalIterator()), n, block_bytes)
    first, second = next(runs, []), next(runs, None)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "hit_items", "hit_ranges"]
    flag = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    if second is None:
        return with_results(docs, _digest(F.col(text), context.broadcast(first), n), names).withColumn("contaminated", flag)
    row = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    scans = None
    for run in itertools.chain([first, second], runs):
        block = context.broadcast(run)
        found = rows.select(F.col(row).alias("row"), _scan(F.col(text), block, n).alias("scan"))
        found = written(found if scans is None else found.where(F.size("scan.starts") > 0), "decontamination-scan")
        block.unpersist()
        scans = found if scans is None else scans.unionByName(found)
    merged = scans.groupBy("row").agg(F.collect_list("scan").alias("scans"))  # at most one of each block
    digest = merged.select(F.col("row").alias(row), F.arrow_udf(_merged, _DIGEST_DDL)("scans").alias(fresh(docs, "_digest")))
    joined = rows.join(digest, row)
    return with_results(joined, F.col(digest.columns[1]), names).drop(row, digest.columns[1]).withColumn("contaminated", flag)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    keep = find_contamination(held(docs, _text=F.col(str(how.pop("text", "text")))), benchmark, text="_text", **how)  # type: ignore[arg-type]
    return restored(keep.where(~F.col("contaminated")), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how: object) -> DataFrame:
    """docs with the hit words (and what stands between adjacent hit words) cut out of the text column."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, hit in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            if hit:
                place, at, kept = [m.span() for m in _WORD.finditer(t)], 0, []
                for r in hit:
                    kept.append(t[at : place[r["start"]][0]])
                    at = place[r["end"] - 1][1]
                t = "".join([*kept, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    found = find_contamination(held(docs, _text=F.col(text)), benchmark, text="_text", **how)  # type: ignore[arg-type]
    return restored(found, docs.columns, **{text: without("_text", "hit_ranges")})
