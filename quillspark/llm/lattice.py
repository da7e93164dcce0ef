"""Subword lattice likelihood: a unigram model over an existing vocabulary, summed over all segmentations of a text.

The vocabulary is a public tokenizer's, never trained here; its scores start the weights of its pieces, and expectation
maximisation over the training words of the corpus fits them. A text is its words and an end mark; no piece crosses a
word's start, so a text's marginal probability is the product of its words', each by a forward recursion in log space over
the byte lattice of all its segmentations. Bytes that no piece covers have pieces of their own.

Words are counted over all documents, and each distinct word is scored once. The FREQUENT most frequent words go to the
scan of the documents in a broadcast of that bound; the remaining occurrences meet their words in a shuffled join, where none is
frequent, so no key is hot.

Defined results: null and empty texts are the end alone; very long texts and words are scored whole; a null id is a training
document; repeated rows each get their row and count as often; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, crc_bucket, lean, resident, vocabulary_path, written

FREQUENT, ROUNDS = 300_000, 3
#: Lengths above which a word's lattice is walked alone, and words of one length that are walked at a time.
LONG, TOGETHER = 192, 20_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lowered."""
    return text.encode().translate(_LOWER).split() if text else []


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, weights): the pieces of a vocabulary as bytes, a space for a word's start, with weights that sum to 1 from
    its scores: exponentials of log probabilities, or by rank where the scores are merge ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranked = any(s <= -1000 for s in scores)
    for i, s in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.setdefault(bytes([int(piece[3:5], 16)]), 1e-7)
            continue
        raw = (" " + piece[1:] if piece[0] == "▁" else piece).encode().translate(_LOWER)
        if b"\xe2\x96\x81" not in raw:
            found[raw] = found.get(raw, 0.0) + (1.0 / (2.0 - s) if ranked else math.exp(s))
    for b in range(256):
        found.setdefault(bytes([b]), 1e-7)
    weights = np.array(list(found.values()))
    return list(found), weights / weights.sum()


class Lattice:
    """The pieces as a trie in sorted arrays, with their log weights."""

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray):
        self.lw = log_weights
        self.flat = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        for p in pieces:
            for j in range(len(p)):
                if p[: j + 1] not in nodes:
                    nodes[p[: j + 1]] = len(nodes)
                edges[nodes[p[:j]] * 256 + p[j]] = nodes[p[: j + 1]]
        keys = np.array(sorted(edges), dtype=np.int64)
        self.keys, self.child = keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64)
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        for p, i in self.flat.items():
            self.piece[nodes[p]] = i

    def _arcs(self, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of all arcs of equally long words, by their start."""
        n, size = data.shape
        every = np.arange(n)
        for i in range(size):
            rows, node = every, np.zeros(n, dtype=np.int64)
            for j in range(i, min(size, i + self.longest)):
                key = node * 256 + data[rows, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                alive = self.keys[at] == key
                rows, node = rows[alive], self.child[at[alive]]
                if not len(rows):
                    break
                piece = self.piece[node]
                ends = piece >= 0
                if ends.any():
                    yield i, j + 1, rows[ends], piece[ends]

    def _alone(self, word: bytes, count: float | None, expected: np.ndarray | None) -> float:
        """The log probability of one long word; adds its expected pieces."""
        size, lw, flat = len(word), self.lw, self.flat
        into: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        forward = [-math.inf] * (size + 1)
        forward[0] = 0.0
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                if (p := flat.get(word[i:j])) is not None:
                    into[j].append((i, p))
            top = max(forward[i] + lw[p] for i, p in into[j])
            forward[j] = top + math.log(sum(math.exp(forward[i] + lw[p] - top) for i, p in into[j]))
        if expected is not None and count:
            backward = [-math.inf] * (size + 1)
            backward[size] = 0.0
            for j in range(size, 0, -1):
                for i, p in into[j]:
                    backward[i] = float(np.logaddexp(backward[i], backward[j] + lw[p]))
                    expected[p] += count * math.exp(forward[i] + lw[p] + backward[j] - forward[size])
        return forward[size]

    def score(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log marginal probability of each word; with counts, adds the expected number of each piece to expected."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, bounds):
            if not len(group):
                continue
            size = int(sizes[group[0]])
            if size > LONG:
                for k in group.tolist():
                    out[k] = self._alone(b" " + words[k], None if counts is None else float(counts[k]), expected)
                continue
            for part in (group[a : a + TOGETHER] for a in range(0, len(group), TOGETHER)):
                data = np.frombuffer(b"".join(b" " + words[k] for k in part.tolist()), dtype=np.uint8).reshape(len(part), size).astype(np.int64)
                forward = np.full((size + 1, len(part)), -np.inf)
                forward[0] = 0.0
                kept = []
                for i, j, rows, piece in self._arcs(data):
                    forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + self.lw[piece])
                    if expected is not None:
                        kept.append((i, j, rows, piece))
                out[part] = forward[size]
                if expected is not None and counts is not None:
                    backward = np.full((size + 1, len(part)), -np.inf)
                    backward[size] = 0.0
                    weight = counts[part]
                    for i, j, rows, piece in reversed(kept):
                        through = backward[j, rows] + self.lw[piece]
                        backward[i, rows] = np.logaddexp(backward[i, rows], through)
                        expected += np.bincount(piece, weights=weight[rows] * np.exp(forward[i, rows] + through - forward[size, rows]), minlength=len(expected))
        return out


def _lattice(pieces: Any, weights: Any, name: str) -> Lattice:
    return resident(name, lambda: Lattice(pieces.value, weights.value))


def count_words(docs: DataFrame, text: str, train: str, most: int = 400_000) -> DataFrame:
    """(word, n_train, n_all) of the documents' words; tasks send sums, at most most words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[Counter, Counter] = (Counter(), Counter())

        def sums() -> Iterator[pa.RecordBatch]:
            for learned, c in zip((False, True), kept, strict=True):
                n = pa.array(list(c.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), n if learned else pa.array(np.zeros(len(n), np.int64)), n], names=["word", "n_train", "n_all"])
                c.clear()

        for batch in batches:
            learned = batch.column(0).to_pylist()
            for a, run in by_bytes(batch.column(1), 1 << 19):
                for i, t in enumerate(run, a):
                    kept[bool(learned[i])].update(tokens(t))
                    if len(kept[0]) + len(kept[1]) > most:
                        yield from sums()
        yield from sums()

    found = docs.select(train, text).mapInArrow(lean(count), "word binary, n_train bigint, n_all bigint")
    return found.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def fit(words: DataFrame, n_ends: int, path: str, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, float]:
    """(pieces, natural log weights, log weight of the end) after rounds of expectation maximisation over all training words."""
    import uuid

    spark = words.sparkSession
    pieces, weights = vocabulary(path)
    n_pieces = len(pieces)
    shared = spark.sparkContext.broadcast(pieces)
    learned = words.where("n_train > 0").select("word", "n_train")
    end = 0.5
    for _ in range(rounds):
        log_weights, name = spark.sparkContext.broadcast(np.log(weights)), uuid.uuid4().hex

        def expect(batches: Iterator[pa.RecordBatch], log_weights: Any = log_weights, name: str = name) -> Iterator[pa.RecordBatch]:
            expected = np.zeros(n_pieces)
            for batch in batches:
                _lattice(shared, log_weights, name).score(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64), expected)
            found = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(expected[found])], names=["piece", "n"])

        table = learned.mapInArrow(lean(expect), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(n_pieces, 0.1)
        counts[table.column("piece").to_numpy()] += table.column("n").to_numpy()
        total = counts.sum() + n_ends + 0.1
        weights, end = counts / total, (n_ends + 0.1) / total
    return pieces, np.log(weights), math.log(end)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_file: str | None = None, modulus: int = 7, held: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import uuid

    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(crc_bucket(F.col(key), modulus) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    n_ends = rows.where("not held_out").select("key").count()
    words = written(count_words(rows.withColumn("train", ~F.col("held_out")), "text", "train"), "words")
    n_train, n_types = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    n_train, n_types = n_train + n_ends, n_types + (n_ends > 0)
    floor = math.log10(n_train + n_types + 1)
    pieces, log_weights, end = fit(words, n_ends, vocabulary_file or vocabulary_path("piece_bpe_32k.model"))
    shared, log_shared, name = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(log_weights), uuid.uuid4().hex

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy()
            s = _lattice(shared, log_shared, name).score(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.log10(c + 1.0) - floor), pa.array(s)], names=["word", "n_train", "n_all", "base", "score"])

    rated = written(words.mapInArrow(lean(rate), "word binary, n_train bigint, n_all bigint, base double, score double"), "rated")
    sizes = sorted(((r.n_all, r["count"]) for r in rated.groupBy("n_all").count().where(F.col("n_all") > 1).collect()), reverse=True)
    reached = list(itertools.takewhile(lambda x: x[1] <= frequent, zip((n for n, _ in sizes), itertools.accumulate(c for _, c in sizes), strict=True)))
    least = reached[-1][0] if reached else 1 << 62
    often = rated.where(F.col("n_all") >= least).select("word", (F.col("n_train") > 0).cast("double").alias("known"), "base", "score").toArrow()
    table = spark.sparkContext.broadcast((often.column("word").to_pylist(), np.stack([often.column(c).to_numpy() for c in ("known", "base", "score")]) if len(often) else np.zeros((3, 0))))
    name2 = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, known = resident(name2, lambda: ({w: i for i, w in enumerate(table.value[0])}, np.concatenate([table.value[1], np.zeros((3, 1))], axis=1)))
        last = known.shape[1] - 1
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, run in by_bytes(batch.column(2), 1 << 19):
                part = batch.slice(a, len(run))
                found = [tokens(t) for t in run]
                sizes = np.array([len(w) for w in found], dtype=np.int64)
                at = np.fromiter((i for w in found for i in map(place.get, w, itertools.repeat(last))), dtype=np.int64, count=int(sizes.sum()))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(x[at])])[bounds]) for x in known]
                ids = np.arange(row, row + part.num_rows)
                row += part.num_rows
                none = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), none, pa.array(sizes + 1), part.column(0), part.column(1), *(pa.array(s) for s in sums)], names=names)
                rare = Counter()
                docs_of = np.repeat(np.arange(len(found)), sizes)
                flat = list(itertools.chain.from_iterable(found))
                for k in np.flatnonzero(at == last).tolist():
                    rare[int(docs_of[k]), flat[k]] += 1
                n = len(rare)
                zeros = pa.array(np.zeros(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[[d for d, _ in rare]] if n else np.zeros(0, np.int64)), pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int64()), pa.nulls(n, part.schema.field(0).type), pa.nulls(n, pa.bool_()), zeros, zeros, zeros], names=names
                )

    names = ["row", "word", "n", "key", "held_out", "known", "base", "score"]
    scanned = written(rows.mapInArrow(lean(scan), f"row bigint, word binary, n bigint, key {kind}, held_out boolean, known double, base double, score double"), "scanned")
    whole = scanned.where("word is null").select("row", "n", "key", "held_out", "known", "base", "score")
    rare = scanned.where("word is not null").select("row", "word", "n").join(rated.where(F.col("n_all") < least).select("word", (F.col("n_train") > 0).cast("double").alias("known"), "base", "score"), "word")
    # a row's sums need neither its id nor its text, so the two meet by the row's number
    sums = rare.groupBy("row").agg(*[F.sum(F.col("n") * F.col(c)).alias(f"rare_{c}") for c in ("known", "base", "score")])
    out = whole.join(sums, "row", "left")
    total = lambda c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0.0))
    end_base = math.log10(n_ends + 1) - floor
    return out.select(
        F.col("key").alias(key), "held_out", F.col("n").alias("n_tokens"), (F.round(total("known")).cast("long") + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (total("base") + F.lit(end_base)).alias("base_score"), (total("score") + F.lit(end / math.log(10))).alias("score"),
    )
