"""Whole-text encoding with public tokenizer files, in runs balanced by UTF-8 bytes.

Long texts are split only where no piece of the vocabulary can span: before ASCII white space. For the word vocabulary,
whose normaliser and pre-tokenizer stop there too, a run is cut into pre-tokens with array operations over its bytes; the
run's distinct pre-tokens that a small cache lacks go to the library in one batch call. Cache and memo are bounded by bytes.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import resident

#: Bytes of text to a run, from which texts are split, and bytes that a memo of unusual strings may hold.
RUN = 1 << 19
MEMO_BYTES = 8 << 20
#: Slots of the pre-token cache (a power of two), its bytes of a pre-token, and the ids that a slot holds at most; new
#: pre-tokens to a line of the batch call.
SLOTS_LOG2, WIDE, HOLDS, LINE = 20, 16, 8, 512

_CUT = re.compile(rb"[\t\n\r ]")
#: The word vocabulary's own pre-token pattern, a fixed value.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, DIGIT, MARK, UNUSUAL = range(5)


def _byte_classes() -> np.ndarray:
    """Class of each byte of lower-cased text in white space, printable ASCII and Latin-1 letters (as UTF-8); other bytes,
    and the two Latin-1 signs among the letters, are UNUSUAL."""
    out = np.full(256, UNUSUAL, dtype=np.uint8)
    out[0x21:0x7F] = MARK
    out[list(b"\t\n\r ")] = SPACE
    out[list(b"0123456789")] = DIGIT
    out[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
    out[0xC3] = LETTER
    out[0x80:0xC0] = LETTER
    out[[0x97, 0xB7]] = UNUSUAL
    return out


_CLASS = _byte_classes()
#: Lowers ASCII capitals, and the second bytes of Latin-1 capitals. Text with other such second bytes is UNUSUAL anyway.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def parts(texts: pa.Array, most: int = RUN) -> Iterator[list[tuple[int, bytes]]]:
    """Runs of (index, UTF-8 part) of about most bytes each; a longer text is split before ASCII white space where it has any."""
    run: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        raw, at = t.as_py() or b"", 0
        while len(raw) - at > most and (m := _CUT.search(raw, at + most)):
            yield [(i, raw[at : m.start()])]
            at = m.start()
        if run and size + len(raw) - at > most:
            yield run
            run, size = [], 0
        run.append((i, raw[at:] if at else raw))
        size += len(raw) - at
    if run:
        yield run


class Encoder:
    """Ids or their numbers for runs of texts by the library's batch call, without added special tokens."""

    def __init__(self, path: str, ids: bool):
        self.ids = ids
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            if ids:
                self.batch = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            else:
                self.batch = lambda texts: self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text i are ids[bounds[i]:bounds[i + 1]]; ids stays empty where only numbers are wanted."""
        found = self.batch([t.decode() for t in texts])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(bounds[-1])) if self.ids else np.zeros(0, np.uint32)
        return bounds, flat


class WordEncoder(Encoder):
    """The same results for a word vocabulary: the library gets each distinct pre-token of a run that the cache lacks.

    The cache is direct-mapped: a slot holds one pre-token of up to WIDE bytes, compared whole, with its number of ids and,
    if wanted, up to HOLDS ids. Longer pre-tokens, and runs of non-space that hold UNUSUAL bytes or may hold a special
    string, go to the library's whole chain and a memo of strings.
    """

    def __init__(self, path: str, ids: bool):
        super().__init__(path, ids)
        slots = 1 << SLOTS_LOG2
        self.words = np.zeros((2, slots), dtype=np.uint64)  # no pre-token is two zeros, as NUL is UNUSUAL
        self.sizes = np.zeros(slots, dtype=np.uint8)
        from tokenizers import Tokenizer, pre_tokenizers

        self.lines = Tokenizer(self.tokenizer.model)  # shares the model
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size, suffix = self.tokenizer.get_vocab_size(), self.tokenizer.model.end_of_word_suffix
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])  # whether an id ends a pre-token
        self.held = np.zeros((slots, HOLDS) if ids else (0, HOLDS), dtype=np.uint16 if len(self.last) <= 1 << 16 else np.uint32)
        self.memo: dict[bytes, object] = {}
        self.memo_bytes = 0

    def _batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each pre-token, all ids in a row), from one batch call over lines of pre-tokens, which need no
        more normalising or splitting than at their spaces."""
        lines = [b" ".join(words[a : a + LINE]).decode() for a in range(0, len(words), LINE)]
        found = self.lines.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in found)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a pre-token has no last piece")
        return np.diff(ends, prepend=0), ids

    def _unusual(self, strings: list[bytes]) -> list:
        """What the batch call gives for each string (its number of ids where only that is wanted), through the memo."""
        new = [s for s in dict.fromkeys(strings) if s not in self.memo]
        made = dict(zip(new, (x if self.ids else len(x) for x in self.batch([s.decode() for s in new])), strict=True))
        out = [made[s] if s in made else self.memo[s] for s in strings]
        grown = sum(len(s) + 120 + (8 * len(x) if self.ids else 0) for s, x in made.items())
        if self.memo_bytes + grown > MEMO_BYTES:
            self.memo, self.memo_bytes = {}, 0
        if grown <= MEMO_BYTES:
            self.memo |= made
            self.memo_bytes += grown
        return out

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n".join([*texts, b""])
        low = raw.translate(_LOWER)
        data = np.frombuffer(low + bytes(WIDE), dtype=np.uint8)[: len(low)]
        kind = _CLASS[data]
        if b"<|" in raw:
            kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = UNUSUAL
        odd_at, odd = self._set_aside(raw, kind)
        starts, sizes = _pre_tokens(data, kind)
        n, base, pool, from_pool = self._looked_up(low, starts, sizes)
        if len(odd_at):
            order = np.argsort(np.concatenate([starts, odd_at]), kind="stable")
            starts = np.concatenate([starts, odd_at])[order]
            counts = np.array([len(x) if self.ids else x for x in odd], dtype=np.int64)
            if self.ids:
                more = np.fromiter(itertools.chain.from_iterable(odd), dtype=np.uint32, count=int(counts.sum()))
                base = np.concatenate([base, len(pool) + np.cumsum(counts) - counts])[order]
                pool, from_pool = np.concatenate([pool, more]), np.concatenate([from_pool, np.ones(len(odd), bool)])[order]
            n = np.concatenate([n, counts])[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = ends[np.searchsorted(starts, edges)]
        if not self.ids:
            return bounds, np.zeros(0, np.uint32)
        place = np.repeat(base - ends[:-1], n) + np.arange(ends[-1])
        if not from_pool.any():
            return bounds, self.held.ravel()[place]
        pooled = np.repeat(from_pool, n)
        flat = np.empty(len(place), dtype=np.uint32)
        flat[pooled] = pool[place[pooled]]
        flat[~pooled] = self.held.ravel()[place[~pooled]]
        return bounds, flat

    def _set_aside(self, raw: bytes, kind: np.ndarray) -> tuple[np.ndarray, list]:
        """Starts of the runs of non-space with UNUSUAL bytes, and what they encode to; kind has them blanked."""
        bad = np.flatnonzero(kind == UNUSUAL)
        if not len(bad):
            return bad, []
        solid = np.concatenate([[False], kind != SPACE, [False]])
        change = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = change[::2], change[1::2]
        of = np.unique(np.searchsorted(starts, bad, side="right") - 1)
        starts, ends = starts[of], ends[of]
        strings = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            strings.append(raw[a:b])
            kind[a:b] = SPACE
        return starts, self._unusual(strings)

    def _looked_up(self, low: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids, place of the first, pool, whether the place is in the pool or in the cache) of each pre-token."""
        padded = low + bytes(WIDE + 8)
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        w0 = eight[starts] & _MASKS[np.minimum(sizes, 8)]
        w1 = eight[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
        h = (w0 ^ (w1 * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        hit = (self.words[0, slot] == w0) & (self.words[1, slot] == w1) & (sizes <= WIDE)
        n, base, pool = self.sizes[slot].astype(np.int64), slot * HOLDS, np.zeros(0, np.uint32)
        if hit.all():
            return n, base, pool, ~hit
        lost = np.flatnonzero(~hit)
        small = lost[sizes[lost] <= WIDE]
        order = np.lexsort((w1[small], w0[small]))
        small = small[order]
        new = np.concatenate([[True], (w0[small][1:] != w0[small][:-1]) | (w1[small][1:] != w1[small][:-1])])[: len(small)]
        first, group = small[new], np.cumsum(new) - 1
        large = lost[sizes[lost] > WIDE]
        cut = [low[a : a + k] for a, k in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)]
        counts, pool = self._batch(cut)
        long = self._unusual([low[a : a + k] for a, k in zip(starts[large].tolist(), sizes[large].tolist(), strict=True)])
        counts = np.concatenate([counts, np.array([len(x) if self.ids else x for x in long], dtype=np.int64)])
        of = np.concatenate([group, len(cut) + np.arange(len(large))])
        at = np.concatenate([small, large])
        n[at] = counts[of]
        begins = np.cumsum(counts) - counts
        if self.ids:
            pool = np.concatenate([pool, np.fromiter(itertools.chain.from_iterable(long), dtype=np.uint32)])
            base[at] = begins[of]
        keep = np.flatnonzero((counts[: len(cut)] <= HOLDS) | (not self.ids))
        into = slot[first[keep]]
        self.words[0, into], self.words[1, into] = w0[first[keep]], w1[first[keep]]
        self.sizes[into] = counts[keep]
        # two new pre-tokens may share a slot: the last one written has both halves, the number and the ids
        if self.ids:
            k = np.arange(HOLDS)
            source = np.minimum(begins[keep][:, None] + k, max(len(pool) - 1, 0))
            self.held[into] = np.where(k < counts[keep][:, None], pool[source] if len(pool) else 0, 0)
            still = hit & ((self.words[0, slot] != w0) | (self.words[1, slot] != w1))  # hits that a new one has replaced
            if still.any():
                return self._replaced(low, starts, sizes, n, base, pool, hit, still)
        return n, base, pool, ~hit

    def _replaced(self, low: bytes, starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, base: np.ndarray, pool: np.ndarray, hit: np.ndarray, still: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, with the ids of pre-tokens that lost their slot to others of this run in the pool."""
        at = np.flatnonzero(still)
        found = self._unusual([low[a : a + k] for a, k in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
        counts = np.array([len(x) for x in found], dtype=np.int64)
        base[at] = len(pool) + np.cumsum(counts) - counts
        pool = np.concatenate([pool, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))])
        return n, base, pool, ~(hit & ~still)


def _pre_tokens(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the pre-tokens of lower-cased bytes: runs of letters, runs of marks, single digits, contractions."""
    before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
    start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    quote = np.flatnonzero((data == 0x27) & (before != MARK) & (kind == MARK))
    if len(quote):
        quote = quote[quote + 2 < len(data)]
        a, b = data[quote + 1], np.where(kind[quote + 2] == LETTER, data[quote + 2], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (kind[quote + 1] == LETTER)
        two = ((a == 0x72) & (b == 0x65) | (a == 0x76) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & (kind[quote + 1] == LETTER)
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < len(data)]
            start[after] |= kind[after] == LETTER
    end = kind != SPACE
    end[:-1] &= start[1:] | (kind[1:] == SPACE)
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) - starts + 1


def _is_word_vocabulary(path: str) -> bool:
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    splits = [p for p in pre.get("pretokenizers", []) if p.get("type") == "Split"]
    return bool(splits) and splits[0].get("behavior") == "Removed" and splits[0].get("pattern") == {"Regex": _PATTERN} and bool((spec.get("model") or {}).get("end_of_word_suffix"))


def encoder(path: str, ids: bool) -> Encoder:
    """The worker's encoder of a tokenizer file; it holds some 60 MB at most."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = resident(("encoders", path), dict)
    if ids not in own:
        own[ids] = (WordEncoder if not path.endswith(".model") and _is_word_vocabulary(path) else Encoder)(path, ids)
    return own[ids]


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    """The number of ids of each whole text."""
    out = np.zeros(len(texts), dtype=np.int64)
    for run in parts(texts):
        bounds, _ = encoder(path, False).run([b for _, b in run])
        np.add.at(out, [i for i, _ in run], np.diff(bounds))
    return out


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each whole text in turn."""
    waiting: list[np.ndarray] = []
    at = 0
    for run in parts(texts):
        bounds, ids = encoder(path, True).run([b for _, b in run])
        for (i, _), a, b in zip(run, bounds.tolist(), bounds[1:].tolist(), strict=False):
            if i != at:
                yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                waiting, at = [], i
            waiting.append(ids[a:b])
    if waiting:
        yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
