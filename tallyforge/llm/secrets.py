"""Secret scans with a recursive decoding worklist.

The text itself is layer 0. Every layer is scanned for the three kinds of secrets. Regions of a layer that are
percent-encoded, escaped (Unicode escapes, character references) or base64 are decoded to new layers, and zlib, gzip,
bzip2 or raw deflate data in decoded layers, also in inflated ones, are inflated to such; all are put on the
worklist until no new layer appears; a layer whose content has been seen in the same text is not visited again, so
cycles end. Each layer maps its characters to spans of the whole text; a hit in a deeper layer is reported as the span
of the text that encodes it.

Base spans are those of layer 0. Hits of deeper layers are added to ``spans``, also inside of base spans; the counts and
``base_sha256`` are of the base spans.

Nulls and edge cases: a null text counts as empty and has no spans; repeated rows are scanned each for itself; an empty
table gives no rows. Compressed data are inflated in pieces of about ``PIECE`` characters, each a layer that repeats the
last ``OVERLAP`` of the one before. A piece ends before any encoded or packed region or secret that is open at its border, which the
next one has whole, so that a small blob that inflates to a huge text is scanned whole in memory for a piece and its
longest region. Layers lie as deep as they like; each step makes them shorter. Of an escape character that is escaped by
itself in more than ``LEVELS`` levels (%252525...) the outer levels are unwrapped together, without layers between them.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html.entities
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\U([0-9A-Fa-f]{8})|&([A-Za-z][A-Za-z0-9]{1,31};)")
_ESCAPED = re.compile(r"\\[uxU]|&[#A-Za-z]")
# Letters of a region go on over single line ends and the indent behind them.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-](?:(?:\r?\n[ \t]*)?[A-Za-z0-9+/_-]){15})[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_LETTERS = {ord("-"): "+", ord("_"): "/", **dict.fromkeys(map(ord, " \t\r\n"))}
# What the shortest hit takes: token=12345678 has 14 characters, and no encoding has fewer.
_ASCII_RUN = re.compile(r"[\t\r\n -~]{14}")
# UTF-16 of characters below U+0100, either end first.
_WIDE = re.compile(r"(?:\xfe\xff)?((?:\0[\x01-\xff]){8,})|((?:[\x01-\xff]\0){8,})")
_MEMBER = re.compile(rb"\0*(\x1f\x8b\x08)")
# Beginnings of gzip and bzip2 data, and of zlib data without a preset dictionary.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|" + b"|".join(re.escape(bytes([x])) + b"[" + b"".join(b"\\x%02x" % y for y in range(256) if (x << 8 | y) % 31 == 0 and not y & 32) + b"]" for x in range(0x08, 0x80, 16)))
# Backwards, what may go on behind a border: letters of all regions, also of UTF-16, over line ends.
_OPEN = re.compile(r"[ \t\0]*+(?:\n\0?\r?|\r)?(?:(?:[A-Za-z0-9+/_=%\\{}&#;.-]++|\0[A-Za-z0-9+/_=%\\{}&#;.-]++)++\0?(?:[ \t\0]*+\n\0?\r?)?)*+")
_OPEN_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*(?:[:=]\x20*["']?[A-Za-z0-9+/_.=-]*)?\Z""", re.IGNORECASE | re.ASCII)
PIECE, OVERLAP, BLOCK = 1 << 22, 1 << 12, 1 << 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one layer, leftmost non-overlapping for each kind, ordered by start, then kind."""
    found = []
    if _WORDS.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


class _Same:
    """An array of one value."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __getitem__(self, i):
        if isinstance(i, slice):
            return np.full(len(range(self.n)[i]), self.value)
        return np.full(len(i), self.value) if isinstance(i, np.ndarray) else self.value


class _Counted:
    """The array of the numbers from ``first`` on, made where it is looked at."""

    def __init__(self, first: int, n: int):
        self.first, self.n = first, n

    def __getitem__(self, i):
        if isinstance(i, slice):
            part = range(self.n)[i]
            return np.arange(part.start, part.stop) + self.first
        return i + self.first if isinstance(i, np.ndarray) else range(self.n)[i] + self.first


class Layer:
    """A text and, for each of its characters, the start and end of the source span it came from.

    Both are arrays, worked out once from those of the layer around; so a layer costs no more the deeper it lies.
    """

    __slots__ = ("text", "starts", "ends", "depth", "searched")

    def __init__(self, text: str, starts, ends, depth: int, searched: bool = False):
        self.text, self.starts, self.ends, self.depth = text, starts, ends, depth
        self.searched = searched  # whether compressed data have been looked for

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the whole text behind the characters start to end."""
        return int(self.starts[start]), int(max(self.ends[start], self.ends[end - 1]))


def _spliced(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with regions replaced: pieces are (start, end, decoded, source span of each decoded character)."""
    text, starts, ends, at = [], [], [], 0
    for start, end, decoded, spans in pieces:
        text += (layer.text[at:start], decoded)
        starts += layer.starts[at:start].tolist()
        ends += layer.ends[at:start].tolist()
        starts += [a for a, _ in spans]
        ends += [b for _, b in spans]
        at = end
    text.append(layer.text[at:])
    starts += layer.starts[at:].tolist()
    ends += layer.ends[at:].tolist()
    return Layer("".join(text), np.array(starts, np.int64), np.array(ends, np.int64), layer.depth + 1)


#: Levels of an escape of its own escape character that are unwrapped one by one.
LEVELS = 16
_CHAIN = re.compile("|".join(rf"{first}({unit}){{{LEVELS + 1},}}" for first, unit in (("%", "25"), ("&", "amp;"), ("&", "#38;"), ("&", "#x26;"), (r"\\", "u005[cC]"), (r"\\", "x5[cC]"))))


def _shortened(layer: Layer) -> Layer:
    """The layer with no escape character escaped by itself in more than LEVELS levels, such as %252525...; the levels
    around these hold nothing but ever shorter rows of the same escape, and one by one they would take quadratic time."""
    pieces = []
    for m in _CHAIN.finditer(layer.text):
        unit = next(u for u in m.groups() if u)
        tail = m.end() - LEVELS * len(unit)
        spans = [layer.source(m.start(), tail), *(layer.source(i, i + 1) for i in range(tail, m.end()))]
        pieces.append((m.start(), m.end(), m[0][0] + m[0][-LEVELS * len(unit) :], spans))
    return _spliced(layer, pieces) if pieces else layer


def _unpercent(layer: Layer) -> Layer | None:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        decoded, at, spans = raw.decode("utf-8", "replace"), m.start(), []
        if "�" in decoded and "�".encode() not in raw:
            decoded = raw.decode("latin-1")
            widths = [1] * len(raw)
        else:
            widths = [len(c.encode()) for c in decoded]
        for w in widths:
            spans.append(layer.source(at, at + 3 * w))
            at += 3 * w
        pieces.append((m.start(), m.end(), decoded, spans))
    return _spliced(layer, pieces) if pieces else None


def _unescape(layer: Layer) -> Layer | None:
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        if m[7]:
            named = html.entities.html5.get(m[7])
            if named:
                pieces.append((m.start(), m.end(), named, [layer.source(*m.span())] * len(named)))
            continue
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
        if code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            pieces.append((m.start(), m.end(), chr(code), [layer.source(*m.span())]))
    return _spliced(layer, pieces) if pieces else None


class _Bunzip:
    """A bzip2 decompressor with the interface of zlib's."""

    def __init__(self):
        self.engine, self.unconsumed_tail = bz2.BZ2Decompressor(), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        try:
            out = self.engine.decompress(data if self.engine.needs_input else b"", most)
        except OSError as error:
            raise zlib.error(str(error)) from error
        # What was taken in stays inside; a byte stands for the rest until more input is needed.
        self.unconsumed_tail = b"" if self.engine.needs_input or self.engine.eof else b"\0"
        return out

    def flush(self) -> bytes:
        return b""

    eof = property(lambda self: self.engine.eof)
    unused_data = property(lambda self: self.engine.unused_data)


class _Stream:
    """The text of zlib, gzip, bzip2 or raw deflate data at a place of raw, as Latin-1, with the members that follow."""

    def __init__(self, raw: bytes, at: int, bare: bool = False):
        self.raw, self.at = raw, at
        self.engine = (lambda: zlib.decompressobj(-15)) if bare else _Bunzip if raw.startswith(b"BZh", at) else lambda: zlib.decompressobj(47)
        self.whole = False  # once all is read: whether the data end by their checksum; ``at`` is behind them then
        self.short = False  # and whether they go on behind the end of raw

    def texts(self) -> Iterator[str]:
        """The text in pieces; ends at the first error."""
        engine, rest = self.engine(), b""
        view = memoryview(self.raw)
        while True:
            if not rest:
                rest = bytes(view[self.at : self.at + BLOCK])
                self.at += len(rest)
            try:
                out = engine.decompress(rest, PIECE) if rest else engine.flush()
            except zlib.error:
                return
            if out:
                yield out.decode("latin-1")
            if engine.eof:
                self.at -= len(engine.unused_data)
                self.whole = True
                member = _MEMBER.match(self.raw, self.at)
                if not member:
                    return
                self.at, self.whole = member.start(1), False
                engine, rest = zlib.decompressobj(47), b""
            elif not rest:
                self.short = True
                return
            else:
                rest = engine.unconsumed_tail


def _ended(stream: _Stream) -> _Stream:
    """The stream, read to its end."""
    for _ in stream.texts():
        pass
    return stream


def _is_deflated(raw: bytes) -> bool:
    """Whether raw deflate data begin here and end by themselves; they have no mark that tells, so all is read."""
    if not raw or raw[0] & 6 == 6:  # no such kind of block
        return False
    stream, some = _Stream(raw, 0, True), False
    for text in stream.texts():
        some = some or _may_go_on(text)
    return stream.whole and some


def _may_go_on(text: str) -> bool:
    """Whether an inflated text can hold a hit at any depth; what is packed in it is looked into as a layer."""
    if _may_hit(text):
        return True
    raw = text.encode("latin-1")
    return bool(_PACKED.search(raw)) or bool(raw) and raw[0] & 6 != 6 and _ended(_Stream(raw, 0, True)).whole


def _outside_packed(raw: bytes, cut: int, first: bool) -> int:
    """The place of the cut, or the beginning of compressed data that it would part; raw deflate at the beginning of the
    first piece only."""
    parted = lambda stream: stream.short or stream.whole and stream.at > cut
    if first and raw[0] & 6 != 6 and parted(_ended(_Stream(raw, 0, True))):
        return 0
    z = _PACKED.search(raw)
    while z and z.start() < cut:
        stream = _ended(_Stream(raw, z.start()))
        if parted(stream):
            return z.start()
        z = _PACKED.search(raw, stream.at if stream.whole else z.start() + 1)
    return cut


def _closed(text: str) -> int:
    """The place in a text behind which a region or secret may be that goes on behind its end."""
    m = _OPEN_ASSIGN.search(text)
    end = m.start() if m else len(text)
    return end - _OPEN.match(text[:end][::-1]).end()


def _inflated(stream: _Stream) -> Iterator[str]:
    """The text of a stream in pieces, each with the end of the one before."""
    last, more, n, first = "", [], 0, True
    for piece in stream.texts():
        more.append(piece)
        n += len(piece)
        if n >= max(PIECE, len(last)):
            text = "".join((last, *more))
            cut = _outside_packed(text.encode("latin-1"), _closed(text), first)
            if cut > OVERLAP:
                yield text[:cut]
                first = False
            last, more, n = text[max(0, cut - OVERLAP) :], [], 0
    if last or more:
        yield "".join((last, *more))


def _printable(text: str) -> bool:
    return all(c.isprintable() or c in "\t\r\n" for c in text)


def _may_hit(text: str) -> bool:
    """Whether decoded bytes can hold a hit at any depth; false for nearly all that are not text."""
    return bool(_ASCII_RUN.search(text) or "\0" in text and _WIDE.search(text))


def _narrow(layer: Layer) -> Layer | None:
    """The layer with UTF-16 made single characters, in decoded layers only."""
    pieces = []
    for m in _WIDE.finditer(layer.text):
        k = 1 if m[1] else 2
        decoded = m[k].replace("\0", "")
        pieces.append((m.start(k), m.end(k), decoded, [layer.source(i, i + 2) for i in range(m.start(k), m.end(k), 2)]))
    return _spliced(layer, pieces) if pieces else None


class _Region:
    """A base64 region: its letters without line ends, and where in the layer they are."""

    def __init__(self, layer: Layer, start: int, text: str):
        self.layer, self.letters = layer, text.translate(_LETTERS).encode()
        self.lines = [start + m.start() for m in _LINE.finditer(text)]
        self.at = [0]
        for m in _LINE.finditer(text):
            self.at.append(self.at[-1] + len(m[0]))

    def places(self, letters: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, letters, "right") - 1
        return np.array(self.lines)[k] + letters - np.array(self.at)[k]

    def source(self, start: int, end: int) -> tuple[int, int]:
        a, b = self.places(np.array([start, end - 1]))
        return self.layer.source(int(a), int(b) + 1)

    def sources(self, skip: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Source starts and ends of n bytes from the byte ``first`` on, where decoding begins at the letter ``skip``."""
        k = np.arange(first, first + n)
        a = self.places(skip + k * 4 // 3)
        b = self.places(np.minimum(len(self.letters), skip - (-(k + 1) * 4 // 3)) - 1)
        return self.layer.starts[a], np.maximum(self.layer.ends[a], self.layer.ends[b])


def _foreign(line: bytes, near: bytes) -> bool:
    """Whether a line of decoded bytes is no text, and not that of the line beside it, whose side ``near`` it shows."""
    if sum(32 <= c < 127 or c in b"\t\r\n" for c in line) >= 0.6 * len(line) or len(near) == 4 and near.isascii() and near.decode().isprintable():
        return False
    return not any(_is_text(line[a : len(line) - b]) for a in range(4) for b in range(4) if a + b < len(line))


def _is_text(raw: bytes) -> bool:
    try:
        return _printable(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _runs(raw: bytes, borders: list[int]) -> Iterator[tuple[int, int]]:
    """raw cut at those borders of lines of which one side is text and the other is not: words before or behind a blob."""
    borders = [0, *sorted({b for b in borders if 0 < b < len(raw)}), len(raw)]
    start, lines = 0, list(itertools.pairwise(borders))
    for (a, b), (_, c) in itertools.pairwise(lines):
        if _foreign(raw[a:b], raw[max(a, b - 4) : b]) != _foreign(raw[b:c], raw[b : min(c, b + 4)]):
            yield start, b
            start = b
    yield start, len(raw)


def _unbase64(layer: Layer) -> Iterator[Layer]:
    """The layers in each base64 region; URL-safe letters count too.

    A region may be wrapped, begin behind other letters of the alphabet or end before such, so it is decoded from each of
    its first four letters on: wherever base64 begins and ends in it, one of them has its bytes. Compressed data are
    looked for at each place of these bytes. Bytes are scanned as Latin-1: all patterns are of ASCII characters, which
    are the same there and in UTF-8.
    """
    for m in _BASE64.finditer(layer.text):
        region = _Region(layer, m.start(), m[0].rstrip("="))
        for skip in range(4):
            part = region.letters[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            z = _PACKED.search(raw)
            while z:
                stream, at = _Stream(raw, z.start()), z.start() + 1
                a, b = region.source(skip + z.start() * 4 // 3, skip + len(part))
                for text in _inflated(stream):
                    if _may_go_on(text):
                        yield Layer(text, _Same(a, len(text)), _Same(b, len(text)), layer.depth + 1)
                if stream.whole:
                    at = stream.at
                    raw = b"".join((raw[: z.start()], bytes(at - z.start()), raw[at:]))
                z = _PACKED.search(raw, at)
            if raw and _is_deflated(raw):
                a, b = region.source(skip, skip + len(part))
                for text in _inflated(_Stream(raw, 0, True)):
                    if _may_go_on(text):
                        yield Layer(text, _Same(a, len(text)), _Same(b, len(text)), layer.depth + 1)
            if not _may_hit(raw.decode("latin-1")):
                continue
            for a, b in _runs(raw, [(x - skip) * 3 // 4 for x in region.at]):
                text = raw[a:b].decode("latin-1")
                if _may_hit(text):
                    yield Layer(text, *region.sources(skip, a, b - a), layer.depth + 1, True)


def _unpack(layer: Layer) -> Iterator[Layer]:
    """The layers of compressed data in a decoded layer, whose characters are bytes; also in what was inflated before.

    Raw deflate data have no mark; they are looked for where inflated bytes begin.
    """
    raw, n = layer.text.encode("latin-1", "replace"), len(layer.text)
    inflated = isinstance(layer.starts, _Same)

    def layers(stream: _Stream, end: int) -> Iterator[Layer]:
        a, b = layer.source(stream.at, end)
        for text in _inflated(stream):
            if _may_go_on(text):
                yield Layer(text, _Same(a, len(text)), _Same(b, len(text)), layer.depth + 1)

    z = _PACKED.search(raw)
    while z:
        if inflated:
            stream = _Stream(raw, z.start())
            yield from layers(stream, n)
        else:
            # The span ends with the data.
            stream = _ended(_Stream(raw, z.start()))
            yield from layers(_Stream(raw, z.start()), stream.at if stream.whole else n)
        z = _PACKED.search(raw, stream.at if stream.whole else z.start() + 1)
    if inflated and _is_deflated(raw):
        yield from layers(_Stream(raw, 0, True), n)


def _inner(layer: Layer) -> list[partial[Layer | None] | Iterator[Layer]]:
    """The layers inside of a layer, made one at a time; the last in the list come first."""
    text = layer.text
    steps = (
        (_unpercent, "%" in text and _PERCENT.search(text)),
        (_unescape, _ESCAPED.search(text) and _ESCAPE.search(text)),
        (_narrow, layer.depth and "\0" in text and _WIDE.search(text)),
    )
    near = _shortened(layer) if any(some for _, some in steps[:2]) else layer
    packed = [_unpack(layer)] if layer.depth and not layer.searched else []
    return [*(partial(one, near) for one, some in steps if some), *packed, _unbase64(layer)]


def _mark(text: str, start: int, end: int) -> bytes:
    return hashlib.sha256(f"{start} {end} {text}".encode("utf-8", "surrogatepass")).digest()


def _may_nest(text: str) -> bool:
    return bool("%" in text and _PERCENT.search(text) or _ESCAPED.search(text) and _ESCAPE.search(text) or _BASE64.search(text))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a whole text; code points, end exclusive, ordered by start, kind, end."""
    base = base_spans(text)
    if not _may_nest(text):
        return base, base
    spans, seen = set(base), {_mark(text, 0, len(text))}
    work = _inner(Layer(text, _Counted(0, len(text)), _Counted(1, len(text)), 0))
    while work:
        # A step that makes one layer goes before its layer is visited, so that long chains hold one layer at a time.
        if isinstance(work[-1], partial):
            layer = work.pop()()
        elif (layer := next(work[-1], None)) is None:
            work.pop()
        if layer is None or not layer.text:
            continue
        mark = _mark(layer.text, layer.starts[0], layer.ends[-1])
        if mark in seen:
            continue
        seen.add(mark)
        spans.update((kind, *layer.source(a, b)) for kind, a, b in base_spans(layer.text))
        work += _inner(layer)
    return base, sorted(spans, key=_order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_SCANNED = "key long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for text in batch.column(1).to_pylist():
            base, whole = scan(text or "")
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(x[0] == kind for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(whole))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The secrets of every text: counts and digest of the base spans, and all spans; other columns are ignored."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_scanned, _SCANNED).withColumnRenamed("key", key)


def query(spark, sf_dir):
    """op3: secrets of all documents."""
    return found(table(spark, sf_dir, "documents"))
