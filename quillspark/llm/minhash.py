"""MinHash near-dedup with DartMinHash signatures.

A document is the bag of its five-word shingles (or, unweighted, their set). Darts are thrown by hash at the unit cells
of the plane of weight and rank above each shingle; those below the shingle's weight and the document's rank limit hit it,
and each of K coordinates keeps its earliest dart. Signatures of bags that share a part s of their weight agree in a
coordinate with probability s. ROWS coordinates make a band, and documents that share a band are candidates.

Candidate links are stars, never all pairs of a bucket: members are compared with the bucket's most connected member, by
exact weighted Jaccard similarity of the whole texts. Where a bucket is then still of several components, its members outside
the largest component are compared with all others, block by block, inside tasks that return links only, one for two components
at most; so no link found by a band is lost, and what is copied grows with the members that are still apart. Copies are one node.

Defined results: a text of 1 to 4 words is one shingle of all of them; null and wordless texts are never duplicates, each
is its own class; very long texts are compared whole; repeated rows are copies; equal ids tie, and the least stands for its
class; null ids take part, and a class whose ids are all null has a null id; other columns are not looked at and may have any
name; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, bounded_batches, by_bytes, held, lean, mix64, restored, trim, written
from .components import FEW, components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and the coordinates of each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**24, 0.99993.
BANDS, ROWS = 24, 5
#: Members and bytes of text to a block of a bucket whose components are compared with each other.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Rows of all among which a content of more than one is met by broadcast where the others are shuffled.
HOT = 1000
#: Standard deviations that a signature's agreement may fall below the similarity before a pair isn't looked at.
SLACK = 4.0
#: Documents (at most 512: a shingle keeps 55 bits beside its document's number) and bytes worked on at a time.
RUN, RUN_BYTES = 256, 1 << 18

_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LUT = np.frombuffer(_FOLD, dtype=np.uint8)
#: Chances that a unit cell has at most 0, 1, 2, ... darts.
_DARTS = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def _runs(column: pa.Array) -> Iterator[list[str | None]]:
    return (run for _, run in by_bytes(column, RUN_BYTES, RUN))


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of up to 512 texts, by document and hash."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(b) + 1 for b in raw], dtype=np.int64)
    data = _LUT[np.frombuffer(b"\0".join([*raw, b""]), dtype=np.uint8)]
    word = np.concatenate([[False], data != 0x20, [False]])
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[::2], change[1::2]
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _ONE) * powers[:-1], dtype=np.uint64)])
    undo = np.full(len(data) + 1, _INVERSE, dtype=np.uint64)
    undo[:1] = 1
    undo = np.multiply.accumulate(undo)
    words = mix64((sums[ends] - sums[starts]) * undo[starts])
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | _ONE
    full = max(len(words) - width + 1, 0)
    h = np.zeros(full, dtype=np.uint64)
    for j in range(width):
        h += words[j : full + j] * factors[j]
    inside = doc[:full] == doc[width - 1 :] if full else np.zeros(0, dtype=bool)
    h, of = h[inside], doc[:full][inside]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short = np.array([(words[first[d] : first[d] + n[d]] * factors[: n[d]]).sum(dtype=np.uint64) + np.uint64(n[d]) for d in few], dtype=np.uint64)
        h, of = np.concatenate([h, short]), np.concatenate([of, few])
    packed, counts = np.unique((of.astype(np.uint64) << np.uint64(55)) | (mix64(h) >> np.uint64(9)), return_counts=True)
    return (packed >> np.uint64(55)).astype(np.int64), packed & np.uint64((1 << 55) - 1), counts


def _throw(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """The darts below each shingle's weight and its document's rank limit, as (document * k + coordinate) << 32 | rank bits."""
    cells = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(x)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1.0, low)
    slices = np.ceil(limit[doc[at]] * width).astype(np.int64)
    on = np.repeat(np.arange(len(at)), slices)
    step = np.arange(len(on)) - np.repeat(np.cumsum(slices) - slices, slices)
    h = mix64(x[at[on]] + mix64(step.astype(np.uint64) * np.uint64(64) + cell[on].astype(np.uint64) + _BASE))
    thrown = np.searchsorted(_DARTS, (h >> np.uint64(11)) * 2.0**-53, side="right")
    dart = np.repeat(np.arange(len(on)), thrown)
    number = np.arange(len(dart)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    g = mix64(h[dart] + (number + 1).astype(np.uint64) * _BASE)
    rank_bits, weight_bits = mix64(g ^ _INVERSE), mix64(g + _INVERSE)
    cell_of = on[dart]
    rank = (step[dart] + (rank_bits >> np.uint64(11)) * 2.0**-53) / width[cell_of]
    height = low[cell_of] + width[cell_of] * ((weight_bits >> np.uint64(11)) * 2.0**-53)
    d = doc[at[cell_of]]
    hit = (rank < limit[d]) & (height < weight[at[cell_of]])
    coordinate = (g[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
    return ((d[hit].astype(np.uint64) * np.uint64(k) + coordinate) << np.uint64(32)) | rank[hit].astype(np.float32).view(np.uint32)


def signatures(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The rank bits of the earliest dart of each coordinate, a row per document; rows without shingles are all ones.

    About k ln k + 2 k darts hit a document, whatever its weight; those that miss a coordinate get more darts, and as a
    coordinate's earliest dart doesn't depend on the limit, the signatures stay comparable.
    """
    out = np.full(n_docs * k, 0xFFFFFFFF, dtype=np.uint32)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    missing = total > 0
    while missing.any():
        part = missing[doc]
        darts = np.sort(_throw(doc[part], x[part], weight[part], limit, k))
        place, first = np.unique(darts >> np.uint64(32), return_index=True)
        out[place.astype(np.int64)] = (darts[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        missing &= (out.reshape(n_docs, k) == 0xFFFFFFFF).any(axis=1)
        limit = np.where(missing, 2 * limit, limit)
    return out.reshape(n_docs, k)


def band_hashes(rows: np.ndarray, bands: int, width: int) -> np.ndarray:
    h = np.zeros((len(rows), bands), dtype=np.uint64)
    h += mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(width):
        h = mix64(h * _BASE + rows[:, j::width].astype(np.uint64))
    return h.view(np.int64)


def _content(texts: list[str | None]) -> list[bytes | None]:
    import xxhash

    return [xxhash.xxh3_128_digest(b" ".join(w)) if t and (w := t.encode().translate(_FOLD).split()) else None for t in texts]


def content(text: Column | str) -> Column:
    """A 128-bit hash of a text's words; null without words."""

    @F.arrow_udf("binary")
    @lean
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([x for run in _runs(texts) for x in _content(run)], pa.binary())

    # else a filter or join by it is pushed below, and each task hashes all texts twice, in two Python workers
    return digest.asNondeterministic()(text)


def sketch(text: Column | str, bands: int = BANDS, width: int = ROWS, weighted: bool = True) -> Column:
    """struct(content, bands): the hash of a text's words, and the hashes of its signature's bands."""

    @F.arrow_udf("struct<content:binary,bands:array<bigint>>")
    @lean
    def draw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            contents, hashes = [], []
            for run in _runs(column):
                doc, x, n = shingles(run)
                weight = n.astype(np.float64) if weighted else np.ones(len(n))
                contents += _content(run)
                hashes.append(band_hashes(signatures(doc, x, weight, len(run), bands * width), bands, width))
            flat = np.concatenate(hashes).ravel() if hashes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(contents, pa.binary()), lists], ["content", "bands"])

    return draw(text)


def _bags(texts: list[str | None], weighted: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, weights) of each text."""
    doc, x, n = shingles(texts)
    n = n if weighted else np.ones_like(n)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(x[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(weight shared, weight in all) of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def similarity(a: Column | str, b: Column | str, weighted: bool = True) -> Column:
    """Exact weighted Jaccard similarity of the shingles of two texts."""

    @F.arrow_udf("double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out, last = [], None
            own: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for s, t in zip(left, right, strict=True):
                t = t.as_py()
                if t != last:  # rows come by centre
                    last, own = t, _bags([t], weighted)[0]
                both, whole = jaccard(own, _bags([s.as_py()], weighted)[0])
                out.append(both / max(1, whole))
            yield pa.array(out, pa.float64())
        trim()

    return compare(a, b)


def _meet(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key, which is broadcast up to a counted bound of FEW rows, so that a key of many rows
    stays spread over tasks; beyond it, adaptive execution splits such a key."""
    table = written(table, "table")
    return rows.join(F.broadcast(table) if table.count() <= FEW else table, key, how)


def _by_content(rows: DataFrame, nodes: DataFrame, n_rows: int) -> DataFrame:
    """rows (with content) plus node, the row of nodes of the same content as a struct, null without one. nodes has one row per content
    and its copies.

    Up to a counted bound of FEW rows nodes are broadcast. Beyond it the contents that more than one row in HOT has, of which
    there are fewer than HOT, are broadcast; the other rows meet their node in a shuffle, in which those rows, and rows without
    content, are dealt by their place, so no content is a hot key.
    """
    table = written(nodes.select("content", "copies", F.struct(*[c for c in nodes.columns if c not in ("content", "copies")]).alias("node")), "contents")
    if table.count() <= FEW:
        return rows.join(F.broadcast(table.drop("copies")), "content", "left")
    hot = table.where(F.col("copies") * HOT > n_rows).select("content", F.col("node").alias("_hot"))
    place = F.monotonically_increasing_id().cast("string").cast("binary")
    dealt = rows.join(F.broadcast(hot), "content", "left").withColumn("_at", F.when(F.col("_hot").isNull() & F.col("content").isNotNull(), F.col("content")).otherwise(F.concat(F.lit("row ").cast("binary"), place)))
    joined = dealt.join(table.select(F.col("content").alias("_at"), "node").hint("merge"), "_at", "left")
    return joined.withColumn("node", F.coalesce("_hot", "node")).select(*rows.columns, "node")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """The pairs (node, centre) whose texts are similar."""
    joined = pairs.join(texts.withColumnsRenamed({"content": "node", "text": "_a"}), "node").join(texts.withColumnsRenamed({"content": "centre", "text": "_b"}), "centre")
    return joined.where(similarity("_a", "_b", weighted) >= least).select("node", "centre")


def _unlinked(members: DataFrame, texts: DataFrame, least: float, bands: int, width: int, weighted: bool) -> DataFrame:
    """Similar pairs (node, centre) that link the different components among the members (band, content, root) of a bucket.

    Only buckets of several components are looked at. Members outside a bucket's largest component are dealt into blocks, and all
    its members too, of at most BLOCK members and BLOCK_BYTES of text; each pair of blocks is compared in its own task: signatures
    first, then the whole texts of likely pairs, each pair in the first band that it shares. Tasks return links only, never the
    pairs compared, and not for components that they have linked already.
    """
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("band", "main")
    rows = written(_meet(members, mixed, "band").join(texts, "content").withColumn("apart", F.col("root") != F.col("main")).drop("main"), "mixed")
    blocks = lambda these: F.greatest(F.ceil(F.count_if(these) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(these, F.octet_length("text"))), F.lit(0)) / BLOCK_BYTES), F.lit(1)).cast("int")
    rows = _meet(rows, rows.groupBy("band").agg(blocks(F.col("apart")).alias("n_left"), blocks(F.lit(True)).alias("n_right")), "band")
    block = lambda n: F.pmod(F.xxhash64("content"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("apart").select("band", "content", "root", "text", F.lit(True).alias("apart"), F.lit(True).alias("left"), block("n_left").alias("i"), every("n_right").alias("j"))
    right = rows.select("band", "content", "root", "text", "apart", F.lit(False).alias("left"), every("n_left").alias("i"), block("n_right").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        side, apart = group.column("left").to_numpy(), group.column("apart").to_numpy()
        names, roots = group.column("content").to_pylist(), np.unique(group.column("root").to_pylist(), return_inverse=True)[1]
        bags, sigs = [], []
        for run in _runs(group.column("text").combine_chunks()):
            own = _bags(run, weighted)
            bags += own
            sizes = [len(x) for x, _ in own]
            sigs.append(signatures(np.repeat(np.arange(len(run)), sizes), np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own]).astype(np.float64), len(run), bands * width))
        sig = np.concatenate(sigs)
        hashes = band_hashes(sig, bands, width)
        here = int(np.flatnonzero((hashes == group.column("band")[0].as_py()).all(axis=0))[0])
        near = max(0.0, least - SLACK * math.sqrt(least * (1 - least) / (bands * width))) * bands * width
        others = np.flatnonzero(~side)
        order = np.array(names, dtype=object)
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for k in np.flatnonzero(side).tolist():
            rest = others[(roots[others] != roots[k]) & (~apart[others] | (order[others] > names[k]))]
            rest = rest[~(hashes[rest, :here] == hashes[k, :here]).any(axis=1)]
            rest = rest[(sig[rest] == sig[k]).sum(axis=1) >= near]
            for m in rest.tolist():
                if roots[m] == roots[k]:
                    continue
                both, whole = jaccard(bags[k], bags[m])
                if both >= least * whole:
                    out[0].append(names[k])
                    out[1].append(names[m])
                    roots[roots == roots[m]] = roots[k]
        trim()
        return pa.table({"node": pa.array(out[0], pa.binary()), "centre": pa.array(out[1], pa.binary())})

    return left.unionByName(right).groupBy("band", "i", "j").applyInArrow(compare, "node binary, centre binary")


def _beside(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """rows with column replaced by its root, where it has one. Roots are broadcast up to a counted bound of FEW rows."""
    table = roots.select(F.col("node").alias(column), F.col("root").alias("_new"))
    if roots.count() <= FEW:
        table = F.broadcast(table)
    return rows.join(table, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(rows.columns)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, width: int = ROWS, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): key and content of each row, and for each distinct content its first key, its copies, how many rows
    have that first key, and the content and key that stand for its class."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = written(docs.select(F.col(key).cast(kind).alias("key"), sketch(F.col(text), bands, width, weighted).alias("s")).select("key", "s.*"), "sketches")
    per_key = rows.where("content is not null").groupBy("content", "key").agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    rank = F.struct(F.col("key").isNull().alias("none"), "key")
    nodes = written(per_key.groupBy("content").agg(F.min(F.struct(rank.alias("rank"), "n")).alias("least"), F.sum("n").alias("copies"), F.first("bands").alias("bands")), "nodes")

    n_rows = rows.count()
    exploded = nodes.select("content", "copies", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = written(_meet(exploded, shared, "band"), "members")
    popular = written(members.groupBy("content").agg(F.sum("size").alias("popularity"), F.first("copies").alias("copies")), "popular")
    given = docs.select(F.col(text).alias("text"), content(F.col(text)).alias("content")).where("content is not null")
    texts = written(_by_content(given, popular, n_rows).where("node is not null").groupBy("content").agg(F.first("text").alias("text")), "candidates")

    ranked = members.select("band", "content").join(popular.drop("copies"), "content")
    centres = ranked.groupBy("band").agg(F.max_by("content", F.struct("popularity", "content")).alias("centre"))
    pairs = _meet(ranked, centres, "band").where("content != centre").select(F.col("content").alias("node"), "centre").distinct()
    roots = written(components(_verified(pairs, texts, least, weighted), "node", "centre"), "roots")
    found = _unlinked(_beside(members.select("band", "content", F.col("content").alias("root")), roots, "root"), texts, least, bands, width, weighted)
    merged = written(components(_beside(_beside(found, roots, "node"), roots, "centre"), "node", "centre"), "merged")
    if not merged.isEmpty():
        old = _beside(roots, merged, "root")
        roots = written(old.union(merged.join(old, "node", "left_anti")), "roots")
    nodes = _beside(nodes.drop("bands").withColumn("root", F.col("content")), roots, "root")
    heads = nodes.groupBy("root").agg(F.min(F.struct("least.rank", "content")).alias("head"))
    heads = heads.select("root", F.col("head.content").alias("head"), F.col("head.rank.key").alias("class_id"))
    return rows.select("key", "content"), nodes.join(heads, "root").select("content", F.col("least.rank.key").alias("first_key"), F.col("least.n").alias("first_rows"), "copies", "head", "class_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """key and class_id of each row; class_id is the least key of the near-duplicates that the row belongs to."""
    rows, nodes = classes(docs, key, text, **how)  # type: ignore[arg-type]
    found = _by_content(rows, nodes.where("copies > 1 or head != content").select("content", "copies", "class_id"), rows.count())
    return found.select(F.col("key").alias(key), F.when(F.col("node").isNotNull(), F.col("node.class_id")).otherwise(F.col("key")).alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """docs with one row of each class, columns as they were: the row of least key, which is whole even where rows repeat."""
    rows, nodes = classes(docs, key, text, **how)  # type: ignore[arg-type]
    nodes = written(nodes.where("copies > 1 or head != content"), "classes")
    keyed = held(docs, key=F.col(key), content=content(F.col(text)))
    out = _by_content(keyed, nodes, rows.count()).where(F.col("node").isNull() | ((F.col("node.head") == F.col("content")) & F.col("key").eqNullSafe(F.col("node.first_key"))))
    if not nodes.where("head = content and first_rows > 1").isEmpty():
        again = F.col("node").isNotNull() & (F.col("node.first_rows") > 1)
        once = out.where(again).groupBy("content").agg(F.first("_row").alias("_row"))
        out = out.where(~F.coalesce(again, F.lit(False))).select("content", "_row").union(once)
    return restored(out, docs.columns)
