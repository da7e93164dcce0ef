"""Connected components of a distributed link table, by alternating large and small stars; nothing goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links up to which one task finds the components: some 60 MB there. More links take the distributed rounds.
FEW = 200_000


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _nearest(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the least of a and its b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def _union_find(links: DataFrame) -> DataFrame:
    """(node, root) of few links, in one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        kind = links_kind
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])

    ddl = links.schema["a"].dataType.simpleString()
    links_kind = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[ddl]
    return links.coalesce(1).mapInArrow(join, f"node {ddl}, root {ddl}")


def components(links: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the links, root being the least node of its component; roots included.

    Up to few links one task joins them. Beyond that, each round joins every node with the least of its neighbours and
    ends when the links no longer change; group minima are combined before they are shuffled, and a hub's links stay
    spread over its neighbours' rows. Both give the same rows.
    """
    links = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b"))
    if links.count() <= few:
        return _union_find(links)
    links = cut(links.distinct())
    before = None
    while (now := _fingerprint(links)) != before and now[0]:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = _nearest(large)
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = cut(moved.where("a != b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
