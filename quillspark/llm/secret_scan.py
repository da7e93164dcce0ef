"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is searched for secrets. With all its escapes resolved (URL and Unicode escapes, HTML
character references) the whole layer is the next one, and so is the whole layer with its encoded runs that are plain text
decoded in place, which finds secrets of which only a part is encoded. Each encoded run (base64, hexadecimal, and gzip, zlib,
bzip2 or xz data inside those) also decodes to a layer of its own; base64 is tried from each place modulo 4 that follows a sign
which may be a separator. This goes on until nothing new appears. A layer that was seen before isn't taken again, so cycles end,
and a sign that is escaped many times by one kind of escape is taken to its last but one escape at once, so deep nesting
costs little. Every character of a layer knows the characters of the text that it came from, so finds in any layer are spans
of the text.

Defined results: null and empty texts have no spans; very long texts are read whole; repeated rows each get their row; equal
spans count once; input columns named like a result give way to it; empty tables give an empty result. Compressed data are
opened as a stream whatever their size, and one secret or encoded run in them may be cut only where more than OVERLAP bytes of
it stand in OPENED bytes without a line break or other place to cut.
"""

from __future__ import annotations

import base64
import bz2
import functools
import hashlib
import itertools
import lzma
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, lean, with_results

KINDS = ("assign", "access", "hex")
#: Compressed data are opened and searched in pieces of about PIECE bytes. A piece grows up to OPENED bytes while it has no
#: place to cut; then neighbours share OVERLAP bytes. Compressed data are told by their first HEAD bytes.
PIECE, OPENED, OVERLAP, HEAD = 1 << 20, 16 << 20, 4 << 20, 1 << 16
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)

# The three secret formats.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: One kind of escape of its own first sign, over and over.
_CHAIN = r"(?P<chain>%(?:25){2,}|&(?:#38;){2,}|&(?:#[xX]26;){2,}|&(?:amp;){2,}|\\(?:u005[cC]){2,}|\\(?:x5[cC]){2,})"
_ESCAPE = re.compile(_CHAIN + r"|%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,31};")
_ONCE = {"%": 3, "&a": 5, "&#3": 5, "&#x": 6, "&#X": 6, "\\u": 6, "\\x": 4}
#: The bytes of secrets, escapes and encoded runs, and a text that is long enough for the shortest secret, token=abcdef.
_INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\{}&#;"
_ASCII = re.compile(rb"[\x20-\x7E]{12}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that are decoded in place: long ones, and short ones where a secret's name stands.
_INLINE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}={0,2}|[A-Za-z0-9+/_-]{6,15}={0,2}(?=[\"']?\x20*[:=]))")
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7E]+")
_SEPARATOR = re.compile("[+/_-]")
#: How compressed data begin in base64, from a place that is no byte's middle.
_HEADS = ("H4sI", "eJ", "eA", "eN", "eF", "Qlpo", "/Td6", "_Td6")
_STANDARD = {0x2D: "+", 0x5F: "/"}
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")


@dataclass
class Layer:
    """A text and, for each of its characters, the span of the original text that it came from (None: itself), or the one span
    that all of them came from."""

    text: str
    starts: list[int] | None = None
    ends: list[int] | None = None
    whole: tuple[int, int] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None or self.ends is None:
            return a, b
        return min(self.starts[a:b]), max(self.ends[a:b])

    def key(self) -> tuple[bytes, int, int]:
        if self.whole is not None or not self.starts or not self.ends:
            return _digest(self.text), *(self.whole or (0, 0))
        return _digest(self.text), self.starts[0], self.ends[-1]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets of one layer."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _decompressor(head: bytes) -> Any:
    """A new decompressor for data with this beginning; None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=128 << 20) if head[:6] == b"\xfd7zXZ\x00" else None


def _is_compressed(head: bytes) -> bool:
    try:
        if (z := _decompressor(head)) is not None:
            z.decompress(head, 1)
            return True
    except _BROKEN:
        pass
    return False


def _members(source: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed data opens to, member after member, in parts of at most PIECE bytes, then what stands behind the last
    member on a line of its own. Broken data end where they break."""
    rest: bytes | None = b""
    while True:
        while len(rest) < 6 and (more := next(source, None)) is not None:
            rest += more
        rest = rest.lstrip(b"\0")
        if (z := _decompressor(rest)) is None:
            yield b"\n" + rest
            yield from source
            return
        try:
            while not z.eof:
                out = z.decompress(rest, PIECE)
                rest = getattr(z, "unconsumed_tail", b"")
                if out:
                    yield out
                if not z.eof and not rest and getattr(z, "needs_input", not out) and (rest := next(source, None)) is None:
                    return
        except _BROKEN:
            return
        rest = z.unused_data


def _kept(source: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes from a temporary file, so that nested generators end there."""
    with tempfile.SpooledTemporaryFile(max_size=PIECE) as file:
        for part in source:
            file.write(part)
        file.seek(0)
        while part := file.read(PIECE):
            yield part


def _opened(data: bytes) -> Iterator[bytes]:
    """Parts of what data and all that is compressed in it open to; each level's beginning comes too, as text may begin like
    compressed data. A level that begins as one before it does ends the opening, so data that open to themselves do."""
    source, seen = iter([data]), set()
    while True:
        head = b""
        while len(head) < HEAD and (part := next(source, None)) is not None:
            head += part
        if head in seen or not _is_compressed(head):
            break
        seen.add(head)
        yield from (head[:HEAD], b"\n")
        source = _members(itertools.chain([head], source))
        if len(seen) % 100 == 0:
            source = _kept(source)
    if seen:
        yield head
        yield from source


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts in pieces that end behind a byte that is in no secret, escape or encoded run. Where OPENED bytes have none,
    the next piece begins OVERLAP bytes before the end."""
    held = bytearray()
    for part in parts:
        held += part
        if len(held) < PIECE:
            continue
        if edge := len(held.rstrip(_INNER)):
            yield bytes(held[:edge])
            del held[:edge]
        elif len(held) >= OPENED:
            yield bytes(held)
            del held[:-OVERLAP]
    yield bytes(held)


def _bytes_layers(data: bytes, place: Callable[[], list[tuple[int, int]]]) -> Iterator[Layer]:
    """The layers of decoded bytes, a character for each byte, as patterns are ASCII; place gives the span of each byte.
    Compressed bytes all come from the whole run."""
    if _is_compressed(data):
        spans = place()
        for piece in _pieces(_opened(data)):
            if _ASCII.search(piece):
                yield Layer(piece.decode("latin-1"), whole=(spans[0][0], spans[-1][1]))
    elif _ASCII.search(data):
        spans = place()
        yield Layer(data.decode("latin-1"), [s for s, _ in spans], [e for _, e in spans])


def _resolved(code: str, chain: bool) -> str:
    """What an escape of a character stands for; a chain's last but one escape; nothing if it stands for none."""
    if chain:
        return code[: next(n for head, n in _ONCE.items() if code.startswith(head))]
    if code[0] == "&" and code[1] != "#":
        return html5.get(code[1:], "")
    digits = code[2:].strip("{};")
    value = int(digits[1:], 16) if digits[:1] in "xX" else int(digits, 10 if code[0] == "&" else 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else ""


def _unescaped(layer: Layer) -> Layer | None:
    """The whole layer with its escapes resolved in one pass; successive byte escapes make UTF-8 characters."""
    text, at = layer.text, 0
    data, spans = [], []
    out, starts, ends = [], [], []

    def flush() -> None:
        nonlocal data, spans
        raw = bytes(data)
        decoded = raw.decode("utf-8", "replace")
        if "\ufffd" in decoded:
            decoded, places = raw.decode("latin-1"), spans
        else:
            places, k = [], 0
            for c in decoded:
                n = len(c.encode())
                places.append((spans[k][0], spans[k + n - 1][1]))
                k += n
        out.append(decoded)
        if layer.whole is not None:
            data, spans = [], []
            return
        starts.extend(s for s, _ in places)
        ends.extend(e for _, e in places)
        data, spans = [], []

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        if layer.whole is not None:
            return
        starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
        ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    found = False
    for m in _ESCAPE.finditer(text):
        if data and m.start() > at:
            flush()
        copy(at, m.start())
        at = m.end()
        code, span = m[0], layer.span(m.start(), m.end())
        if not m["chain"] and (code[0] == "%" or code[:2] == "\\x"):
            data.append(int(code[-2:], 16))
            spans.append(span)
            found = True
            continue
        if data:
            flush()
        if made := _resolved(code, bool(m["chain"])):
            out.append(made)
            if layer.whole is None:
                starts.extend([span[0]] * len(made))
                ends.extend([span[1]] * len(made))
            found = True
        else:
            copy(m.start(), m.end())
    if data:
        flush()
    copy(at, len(text))
    if not found:
        return None
    return Layer("".join(out), starts, ends) if layer.whole is None else Layer("".join(out), whole=layer.whole)


def _base64(run: str) -> bytes:
    """The bytes of a run of the base64 alphabets; a last character that makes no byte is left out."""
    body = run[: len(run) - (len(run) % 4 == 1)].translate(_STANDARD)
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _in_place(layer: Layer) -> Layer | None:
    """The whole layer with its encoded runs that are printable text decoded where they stand."""
    at, out, starts, ends = 0, [], [], []
    for m in _INLINE.finditer(layer.text):
        body = m[0].rstrip("=")
        data, hexed = _base64(body), False
        if _HEX_RUN.fullmatch(body) and _PRINTED.fullmatch(bytes.fromhex(body)):
            data, hexed = bytes.fromhex(body), True
        if not _PRINTED.fullmatch(data):
            continue
        place = None
        if layer.whole is None:
            place = _hex_places(layer, m.start(), len(data)) if hexed else _base64_places(layer, m.start(), len(body), m.end(), len(data))
        for text, a, b in ((layer.text[at : m.start()], at, m.start()), (data.decode("ascii"), None, None)):
            out.append(text)
            if place is not None:
                starts.extend([s for s, _ in place] if a is None else range(a, b) if layer.starts is None else layer.starts[a:b])
                ends.extend([e for _, e in place] if a is None else range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])
        at = m.end()
    if not out:
        return None
    out.append(layer.text[at:])
    if layer.whole is not None:
        return Layer("".join(out), whole=layer.whole)
    n = len(layer.text)
    starts.extend(range(at, n) if layer.starts is None else layer.starts[at:])
    ends.extend(range(at + 1, n + 1) if layer.ends is None else layer.ends[at:])
    return Layer("".join(out), starts, ends)


def _alignments(body: str) -> list[int]:
    """Places of a run from which base64 may begin: its start, the first place of each other remainder modulo 4 that some
    place behind a separator has, and places behind separators where compressed data seem to begin."""
    behind = [m.end() for m in _SEPARATOR.finditer(body)]
    out = {0} | {a % 4 for a in behind}
    out |= {a for a in behind if a >= 4 and body.startswith(_HEADS, a) and _is_compressed(_base64(body[a : a + 64]))}
    return sorted(a for a in out if len(body) - a >= 16)


def _decoded(layer: Layer, done: set[tuple[str, bytes, int, int]]) -> Iterator[Layer]:
    """The layers that a layer opens to: itself without escapes, itself with what is encoded decoded in place, and its encoded
    runs but those in done, which grows."""
    text = layer.text
    if ("%" in text or "\\" in text or "&" in text and ";" in text) and (inner := _unescaped(layer)):
        yield inner
    if inner := _in_place(layer):
        yield inner

    def fresh(m: re.Match[str]) -> bool:  # a run may be both kinds
        key = (m.re.pattern, _digest(m[0]), *layer.span(m.start(), m.end()))
        new = key not in done
        done.add(key)
        return new

    if not any(len(w) >= 16 for w in text.split()):
        return
    for m in _BASE64.finditer(text):
        if fresh(m):
            body = m[0].rstrip("=")
            for a in _alignments(body):
                data = _base64(body[a:])
                yield from _bytes_layers(data, functools.partial(_base64_places, layer, m.start() + a, len(body) - a, m.end(), len(data)))
    for m in _HEX_RUN.finditer(text):
        if fresh(m):
            data = bytes.fromhex(m[0])
            yield from _bytes_layers(data, functools.partial(_hex_places, layer, m.start(), len(data)))


def _hex_places(layer: Layer, a: int, n: int) -> list[tuple[int, int]]:
    """The span of each of the n bytes of a hexadecimal run."""
    return [layer.span(a + 2 * i, a + 2 * i + 2) for i in range(n)]


def _base64_places(layer: Layer, a: int, size: int, end: int, n: int) -> list[tuple[int, int]]:
    """The span of each of the n bytes of a base64 run of size characters; that of the last has the padding up to end."""
    place = [layer.span(a + i * 4 // 3, a + min(size, ((i + 1) * 4 + 2) // 3)) for i in range(n)]
    return [*place[:-1], (place[-1][0], layer.span(end - 1, end)[1])]


def spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base, all) spans of a text as (start, kind, end): those of the text itself, and with those of every inner layer."""
    base = find(text)
    every, seen, done = set(base), set(), set()
    work = [_decoded(Layer(text), done)]
    while work:
        if (inner := next(work[-1], None)) is None:
            work.pop()
            continue
        if inner.text == text or (key := inner.key()) in seen:
            continue
        seen.add(key)
        for a, kind, b in find(inner.text):
            s, e = inner.span(a, b)
            every.add((s, kind, e))
        work.append(_decoded(inner, done))
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda x: (x[0], order[x[1]], x[2])
    return sorted(base, key=by), sorted(every, key=by)


_FIELDS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
_FOUND = pa.struct([(n, pa.int64() if n[:2] == "n_" else pa.string()) for n in _FIELDS])


def scan(text: Column | str) -> Column:
    """struct(n_assign, n_access, n_hex, base_sha256, spans) of each text."""

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    @lean
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        joined = lambda found: ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        for column in batches:
            out = []
            for t in itertools.chain.from_iterable(run for _, run in by_bytes(column, 1 << 20)):
                base, every = spans(t or "")
                kinds = [k for _, k, _ in base]
                out.append({f"n_{k}": kinds.count(k) for k in KINDS} | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every)})
            yield pa.array(out, _FOUND)

    return look(text)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the counts of base secrets by kind, base_sha256 and all spans as kind:start:end, comma-joined."""
    return with_results(docs, scan(F.col(text)), _FIELDS)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every secret span of the text column, encoded ones whole, replaced by mark."""

    @F.arrow_udf("string")
    def without(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t:
                kept, at = [], 0
                for a, _, b in spans(t)[1]:
                    if b > at:
                        kept += [t[at:a], mark] if a >= at else []
                        at = b
                t = "".join([*kept, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, without(F.col(text)))
