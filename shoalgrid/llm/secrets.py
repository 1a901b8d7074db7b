"""Secret scan with a recursive decoding worklist.

The text itself is layer 0. A layer is searched for secrets, then for encoded
parts, each of which becomes a new layer on the worklist:

* percent escapes and ``\\uXXXX``/``\\xXX`` escapes: the layer with all of them
  decoded, byte by byte where a run is no valid UTF-8. After ``STEPS`` such steps
  chains like ``%252525`` are reduced at once to what no step changes further,
  in time linear in the layer;
* base64 runs at each of their four alignments, on one line or wrapped over
  several: the bytes as text (UTF-8, UTF-16) where they hold enough ASCII for a
  secret, and every gzip, zlib, bzip2, xz and zstandard container among them,
  all members, whose content is treated in the same way.

Layers whose content and place were seen before are skipped, so the list runs to
a fixpoint even on self-referring input. Each character of a layer carries the
range of the original text that it came from, so that a secret found at any
depth is reported in code points of the original (content of a compressed
container maps to the whole base64 run).

A container is unpacked piece by piece, and a document holds ``HELD`` unpacked
bytes at a time: a larger content is scanned in overlapping windows, which loses
no secret shorter than the overlap, since all its secrets have the same span.
Only what lies beyond ``STREAMED`` unpacked bytes of one document (a
decompression bomb), or in a container nested in such windows and longer than
one, stays closed, and is counted in the result.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, pieces

KINDS = ("assign", "access", "hex")
#: Bytes of one container's content held at a time, and shared by neighbouring windows of a longer one.
HELD, OVERLAP = 16 << 20, 1 << 20
#: Bytes unpacked for one document; a container that would go beyond is counted as closed.
STREAMED = 4 << 30
#: Escape steps of a layer before chains of escapes are reduced at once.
STEPS = 6
#: ASCII characters that the shortest secret holds: a keyword, a sign and six characters.
SHORTEST = 12

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Lines of base64 that go on in the next line; the newline may itself be escaped.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>]*)+[A-Za-z0-9+/_-]+")
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>]*")
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % SHORTEST)
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}" % SHORTEST)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_URL_SAFE = str.maketrans("-_", "+/")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("via", T.StringType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("via", pa.string())]))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain secrets of one layer."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class _Layer:
    __slots__ = ("text", "first", "last", "via", "steps")

    def __init__(self, text: str, first: np.ndarray | None, last: np.ndarray | None, via: str, steps: int = 0):
        self.text, self.first, self.last, self.via, self.steps = text, first, last, via, steps

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.first is None else (int(self.first[start:end].min()), int(self.last[start:end].max()))

    def derived(self, text: str, starts: np.ndarray, ends: np.ndarray, via: str, steps: int = 0) -> _Layer:
        """A layer whose characters come from [starts, ends) of this one."""
        first = starts if self.first is None else self.first[starts]
        last = ends if self.last is None else self.last[ends - 1]
        return _Layer(text, first, last, f"{self.via}>{via}".lstrip(">"), steps)


# -- escapes -------------------------------------------------------------------


def _decoded(data: bytes) -> tuple[str, np.ndarray]:
    """Text of bytes, an invalid byte as one U+FFFD, and the byte offset at which each character ends."""
    try:
        text = data.decode("utf-8")
        units = np.frombuffer(data, np.uint8)
        return text, np.append(np.flatnonzero((units & 0xC0) != 0x80)[1:], len(data)) if text else np.empty(0, np.int64)
    except UnicodeDecodeError:
        text = data.decode("utf-8", "surrogateescape")
        size = np.array([1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode()) for c in text])
        return re.sub("[\udc80-\udcff]", "�", text), np.cumsum(size)


def _percent(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    text, ends = _decoded(bytes.fromhex(run.replace("%", "")))
    return text, np.append(0, ends[:-1]) * 3, ends * 3


def _unicode(run: str) -> tuple[str, list[int], list[int]]:
    text, starts, ends, i, high = [], [], [], 0, None
    while i < len(run):
        n = 6 if run[i + 1] == "u" else 4
        unit = int(run[i + 2 : i + n], 16)
        if high is not None and 0xDC00 <= unit < 0xE000:
            text[-1], ends[-1], high = chr(0x10000 + ((high - 0xD800) << 10) + unit - 0xDC00), i + n, None
        else:
            high = unit if 0xD800 <= unit < 0xDC00 else None
            text.append("�" if 0xD800 <= unit < 0xE000 else chr(unit))
            starts.append(i)
            ends.append(i + n)
        i += n
    return "".join(text), starts, ends


def _unescaped(layer: _Layer, pattern: re.Pattern, decode, via: str) -> _Layer | None:
    """The whole layer with every match of ``pattern`` decoded, if there is one."""
    out, first, last, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        text, starts, ends = decode(m[0])
        out += [layer.text[at : m.start()], text]
        first += [np.arange(at, m.start()), np.asarray(starts, np.int64) + m.start()]
        last += [np.arange(at + 1, m.start() + 1), np.asarray(ends, np.int64) + m.start()]
        at = m.end()
    if not out:
        return None
    n = len(layer.text)
    return layer.derived("".join([*out, layer.text[at:]]), np.concatenate([*first, np.arange(at, n)]), np.concatenate([*last, np.arange(at + 1, n + 1)]), via, layer.steps + 1)


def _reduced(layer: _Layer) -> _Layer:
    """The layer without any escape of an ASCII character: each is decoded as its last character arrives, and may complete another."""
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []
    digits = frozenset("0123456789abcdefABCDEF")
    for at, c in enumerate(layer.text):
        a, b = at, at + 1
        while True:
            n = 0
            if c in digits:
                if len(out) >= 2 and out[-2] == "%" and out[-1] in digits:
                    n, code = 2, int(out[-1] + c, 16)
                elif len(out) >= 3 and out[-3] == "\\" and out[-2] == "x" and out[-1] in digits:
                    n, code = 3, int(out[-1] + c, 16)
                elif len(out) >= 5 and out[-5] == "\\" and out[-4] == "u" and out[-3] in digits and out[-2] in digits and out[-1] in digits:
                    n, code = 5, int("".join(out[-3:]) + c, 16)
            if not n or code >= 0x80:
                break
            a, c = min(first[-n:]), chr(code)
            del out[-n:], first[-n:], last[-n:]
        out.append(c)
        first.append(a)
        last.append(b)
    return layer.derived("".join(out), np.array(first, np.int64), np.array(last, np.int64), "escapes", STEPS + 1)


# -- bytes ---------------------------------------------------------------------


def _opener(data: bytes, at: int):
    """A decompressor for the container that starts at ``at``, or None."""
    head = data[at : at + 6]
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _unpacked(data: bytes, at: int, used: list[int]) -> Iterator[bytes]:
    """Content of the container at ``at`` and of the members that follow it, in pieces; ``used`` gets where it ends.

    Damaged containers give what precedes the damage.
    """
    import zstandard

    while at < len(data) and (d := _opener(data, at)) is not None:
        try:
            zstd = not hasattr(d, "eof") or type(d).__module__.startswith("zstandard")
            rest = memoryview(data)[at:]
            if zstd:  # it takes no bound on its output, so its input goes in by small steps
                step = 1 << 12
                while len(rest) and not d.eof:
                    if piece := d.decompress(bytes(rest[:step])):
                        yield piece
                    rest = rest[step:]
                unused = len(d.unused_data) + len(rest)
            else:
                piece = d.decompress(rest, 1 << 20)
                yield piece
                while not d.eof:
                    tail = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
                    piece = d.decompress(tail, 1 << 20)
                    if not piece and not (hasattr(d, "unconsumed_tail") and d.unconsumed_tail):
                        return  # cut short
                    yield piece
                unused = len(d.unused_data)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError):
            return
        if not d.eof:
            return
        at = len(data) - unused
        used[0] = at


class _Scan:
    """The worklist over one document."""

    def __init__(self, text: str):
        self.spans: dict[tuple[str, int, int], tuple[bool, str]] = {x: (True, "") for x in find(text)}
        self.seen: set[bytes] = set()
        self.streamed, self.closed = 0, 0
        self.work = [_Layer(text, None, None, "")]
        while self.work:
            self._layer(self.work.pop())

    def _layer(self, layer: _Layer) -> None:
        if layer.via:
            key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
            if layer.text:
                key.update(layer.first.tobytes() + layer.last.tobytes())
            if key.digest() in self.seen:
                return
            self.seen.add(key.digest())
            for kind, a, b in find(layer.text):
                self.spans.setdefault((kind, *layer.span(a, b)), (False, layer.via))
        if layer.steps < STEPS:
            if "%" in layer.text and (x := _unescaped(layer, _PERCENT, _percent, "url")):
                self.work.append(x)
            if "\\" in layer.text and (x := _unescaped(layer, _ESCAPE, _unicode, "unicode")):
                self.work.append(x)
        elif layer.steps == STEPS and (_PERCENT.search(layer.text) or _ESCAPE.search(layer.text)):
            self.work.append(_reduced(layer))
        elif layer.steps > STEPS:  # only characters beyond ASCII are still escaped
            for pattern, decode, via in ((_PERCENT, _percent, "url"), (_ESCAPE, _unicode, "unicode")):
                layer = _unescaped(layer, pattern, decode, via) or layer
        for m in _BASE64.finditer(layer.text):
            self._base64(layer, m[0], np.arange(m.start(), m.end()))
        if "\n" in layer.text or "\\n" in layer.text:
            for m in _WRAPPED.finditer(layer.text):
                keep = np.ones(len(m[0]), bool)
                for gap in _BREAK.finditer(m[0]):
                    keep[gap.start() : gap.end()] = False
                self._base64(layer, _BREAK.sub("", m[0]), np.flatnonzero(keep) + m.start())

    def _base64(self, layer: _Layer, run: str, places: np.ndarray) -> None:
        """Decode a run, whose characters stand at ``places``, at each alignment."""
        run = run.translate(_URL_SAFE)
        for shift in range(4):
            n = len(run) - shift
            n -= n % 4 == 1
            if n < 8:
                break
            data = base64.b64decode(run[shift : shift + n] + "=" * (-n % 4))

            def mapped(starts: np.ndarray, ends: np.ndarray, shift=shift) -> tuple[np.ndarray, np.ndarray]:
                a = shift + starts // 3 * 4 + starts % 3
                b = shift + (ends - 1) // 3 * 4 + (ends - 1) % 3 + 1
                return places[a], places[np.minimum(b, len(places) - 1)] + 1

            self._bytes(layer, data, "base64", mapped, layer.span(int(places[0]), int(places[-1]) + 1))

    def _bytes(self, layer: _Layer, data: bytes, via: str, mapped, whole: tuple[int, int]) -> None:
        """Layers of decoded bytes: their text, if it could hold a secret, and the content of containers among them."""

        def add(text: str, starts: np.ndarray, ends: np.ndarray, how: str) -> None:
            if mapped is None:
                self.work.append(_Layer(text, np.full(len(text), whole[0]), np.full(len(text), whole[1]), f"{layer.via}>{how}".lstrip(">")))
            else:
                self.work.append(layer.derived(text, *mapped(starts, ends), how))

        if _PLAIN.search(data):
            text, ends = _decoded(data)
            add(text, np.append(0, ends[:-1]), ends, via)
        for m in _WIDE.finditer(data):
            ends = np.arange(m.start() + 2, m.end() + 1, 2)
            add(m[0].decode("utf-16-le"), ends - 2, ends, f"{via}>utf-16")
        at = 0 if _opener(data, 0) is not None else -1
        while True:
            if at < 0:
                m = _MAGIC.search(data, -at - 1)
                if not m:
                    break
                at = m.start()
            end = self._container(layer, data, at, via, whole)
            at = -max(end, at + 1) - 1

    def _container(self, layer: _Layer, data: bytes, at: int, via: str, whole: tuple[int, int]) -> int:
        """Scan the content of the container at ``at`` in windows; where the container ends."""
        used, window = [at], bytearray()
        pieces_ = _unpacked(data, at, used)
        for piece in pieces_:
            self.streamed += len(piece)
            if self.streamed > STREAMED:
                self.closed += 1
                break
            window += piece
            if len(window) >= HELD:
                self._window(layer, bytes(window), via, whole)
                del window[:-OVERLAP]
        if window:
            self._window(layer, bytes(window), via, whole)
        return used[0]

    def _window(self, layer: _Layer, data: bytes, via: str, whole: tuple[int, int]) -> None:
        """Work off one window before the next one is unpacked, so that layers don't pile up."""
        outer, self.work = self.work, []
        self._bytes(layer, data, f"{via}>compressed", None, whole)
        while self.work:
            self._layer(self.work.pop())
        self.work = outer


def _entries(scan_: _Scan) -> list[tuple[str, int, int, bool, str]]:
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*k, *v) for k, v in sorted(scan_.spans.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def scan_text(text: str) -> list[tuple[str, int, int, bool, str]]:
    """All (kind, start, end, base, via) of a text, by start, kind as listed, end; one entry for a span and kind."""
    return _entries(_Scan(text))


def scan(df: DataFrame, text: str = "text", out: str = "secrets", closed: str | None = None) -> DataFrame:
    """Add ``out``: array of (kind, start, end, base, via) over the whole text; and ``closed``, if named: containers that stayed closed.

    Null and empty texts have none. Rows pass through one by one, repeated rows
    included; columns already named ``out`` or ``closed`` are replaced. Time is
    linear in the text and what it unpacks to. No shuffle.
    """
    added = [T.StructField(out, T.ArrayType(SPAN))] + ([T.StructField(closed, T.LongType())] if closed else [])
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, closed)])
    schema = T.StructType([*source.schema.fields, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            done = [_Scan(t or "") for t in batch.column(text).to_pylist()]
            found = [pa.array([[dict(zip(("kind", "start", "end", "base", "via"), s)) for s in _entries(x)] for x in done], _ARROW)]
            if closed:
                found.append(pa.array([x.closed for x in done], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names)

    return map_batches(source, run, schema)


def redact_text(text: str) -> str:
    """``text`` with every secret, at any depth, replaced by [REDACTED]; overlapping spans merge."""
    out, at = [], 0
    for _, a, b, _, _ in scan_text(text):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets redacted in ``text``; null stays null."""
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            done = pa.array([None if t is None else redact_text(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], names)

    return map_batches(df, run, df.schema)


def secret_digests(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_closed (containers that stayed closed) of whole texts."""
    found = scan(df.select("doc_id", "text"), closed="n_closed").drop("text")
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        "n_closed",
    )
