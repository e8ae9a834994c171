"""Secret scans with a worklist of decoded layers: URL and Unicode escapes, base64 and compressed data, to a fixpoint.

Every layer found is scanned anew and its matches are mapped to the code points of the original text they stem from. A
digest of every layer seen stops cycles. The scan of a text needs that text only, so nothing is shuffled.

Defined cases: a null text counts as empty and has no spans; ids may be null or repeated, each row is answered; an
empty table gives no rows; equal spans from several layers count once, the outermost layer is kept. Undecodable bytes and
escapes become U+FFFD and cost nothing beside them; base64 is read line by line and joined across line breaks; members that
follow one another are all unpacked, and where bytes are left over or broken the packed bytes are scanned too. A layer that
unpacks to more than max_layer_bytes is never held whole: it is scanned to its end in overlapping chunks and counted in
n_unopened, as a coded run longer than half a chunk is not decoded there as one. Streams that break off or ask for too much memory count too.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorlake.llm.shared import release, small_batches

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
LEAST_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

MAX_LAYER_BYTES = 64 << 20
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
MAX_NESTED = 8  # compressions of an oversized layer within one another
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
CODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
LEAST_CODED, LEAST_LINE = 16, 8
# ASCII in 16-bit units.
WIDE = re.compile(rb"(?:[\t\n\r -~]\0){8}|(?:\0[\t\n\r -~]){8}")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Kind, start and end (code points) of all matches, leftmost and disjoint per kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _percent(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run of escapes with the offsets they come from; U+FFFD for each byte that is no UTF-8."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape"):
        bad = 0xD800 <= ord(c) < 0xE000
        n = 3 if bad else 3 * len(c.encode())
        out.append(("\ufffd" if bad else c, at, at + n))
        at += n
    return out


def _unicode(run: str) -> list[tuple[str, int, int]]:
    if run.startswith("&#"):
        codes, step = [int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])], len(run)
    elif run.startswith("\\u{"):
        codes, step = [int(run[3:-1], 16)], len(run)
    else:
        step = {"u": 6, "x": 4, "U": 10}[run[1]]
        codes = [int(run[i + 2 : i + step], 16) for i in range(0, len(run), step)]
    out: list[tuple[str, int, int]] = []
    k = 0
    while k < len(codes):
        code, upto = codes[k], k + 1
        if 0xD800 <= code < 0xDC00 and upto < len(codes) and 0xDC00 <= codes[upto] < 0xE000:
            code, upto = 0x10000 + ((code - 0xD800) << 10) + codes[upto] - 0xDC00, upto + 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            code = 0xFFFD
        out.append((chr(code), k * step, upto * step))
        k = upto
    return out


class Layer:
    """A decoded text with, for every code point, where in the original it begins and ends, and whether it was decoded.

    A layer that was opened from one coded run has one spot for all its code points instead.
    """

    def __init__(
        self, text: str, depth: int, begins: np.ndarray | None = None, ends: np.ndarray | None = None,
        decoded: np.ndarray | None = None, spot: tuple[int, int] | None = None,
    ) -> None:
        self.text, self.depth, self.begins, self.ends, self.decoded, self.spot = text, depth, begins, ends, decoded, spot

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.spot:
            return self.spot
        return (start, end) if self.begins is None else (int(self.begins[start:end].min()), int(self.ends[start:end].max()))

    def touched(self, start: int, end: int) -> bool:
        return self.spot is not None or (self.decoded is not None and bool(self.decoded[start:end].any()))

    def digest(self) -> bytes:
        where = repr(self.spot).encode() if self.spot else b"" if self.begins is None else self.begins.tobytes()
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass") + where).digest()

    def unescaped(self, pattern: re.Pattern, decode) -> Layer | None:
        """The whole layer with the pattern's runs decoded; other characters keep their place."""
        if self.spot:
            text, n = pattern.subn(lambda m: "".join(c for c, _, _ in decode(m[0])), self.text)
            return Layer(text, self.depth + 1, spot=self.spot) if n else None
        parts, begins, ends, flags, at = [], [], [], [], 0

        def copy(a: int, b: int) -> None:
            parts.append(self.text[a:b])
            begins.append(np.arange(a, b) if self.begins is None else self.begins[a:b])
            ends.append(np.arange(a + 1, b + 1) if self.ends is None else self.ends[a:b])
            flags.append(np.zeros(b - a, bool) if self.decoded is None else self.decoded[a:b])

        for m in pattern.finditer(self.text):
            chars = decode(m[0])
            copy(at, m.start())
            at = m.end()
            where = [self.place(m.start() + a, m.start() + b) for _, a, b in chars]
            parts.append("".join(c for c, _, _ in chars))
            begins.append(np.array([a for a, _ in where], dtype=int))
            ends.append(np.array([b for _, b in where], dtype=int))
            flags.append(np.ones(len(chars), bool))
        if not parts:
            return None
        copy(at, len(self.text))
        return Layer("".join(parts), self.depth + 1, np.concatenate(begins), np.concatenate(ends), np.concatenate(flags))

    def opened(self, limit: int, notes: Notes) -> Iterator[Layer]:
        """Layers of each coded run, within a line and across line breaks, maybe through compression."""
        runs = ((m[0], *m.span()) for m in CODED.finditer(self.text))
        for run, a, b in chain(runs, _wrapped(self.text)):
            raw = _from_base64(run)
            if raw is None:
                continue
            spot = self.place(a, b)
            for data in _contents(raw, limit, notes):
                for text in _texts(data):
                    yield Layer(text, self.depth + 1, spot=spot)

    def inner(self, limit: int, notes: Notes) -> Iterator[Layer]:
        """All layers that decode from this one, one after the other."""
        if "%" in self.text and (found := self.unescaped(PERCENT, _percent)):
            yield found
        if ("\\" in self.text or "&#" in self.text) and (found := self.unescaped(UNICODE, _unicode)):
            yield found
        yield from self.opened(limit, notes)


class Notes:
    """What could not be held or unpacked whole."""

    def __init__(self) -> None:
        self.unopened = 0


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """Coded lines joined across their breaks, with start and end: each block of lines as a whole, and within it each
    stretch of lines of one width with the shorter last one, also with the block's first line, which may begin late."""
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for gap in BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, m.end()))
        widths = [b - a for a, b in lines]
        wanted, k = {(0, len(lines) - 1): None}, 0
        while k < len(lines) - 1:
            upto = k
            while upto + 1 < len(lines) and widths[upto + 1] == widths[k]:
                upto += 1
            last = upto + (upto + 1 < len(lines) and widths[upto + 1] < widths[k])
            if widths[k] >= LEAST_LINE:
                if last > k:
                    wanted[k, last] = None
                if k == 1:
                    wanted[0, last] = None
            k = upto + 1
        for i, j in wanted:
            if sum(widths[i : j + 1]) >= LEAST_CODED:
                yield "".join(text[a:b] for a, b in lines[i : j + 1]), lines[i][0], lines[j][1]


def _from_base64(run: str) -> bytes | None:
    """The bytes of a coded run; a last character that makes no byte is left out."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _kind(raw: bytes) -> str | None:
    """The compression that the first bytes name."""
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return "zlib"
    if raw[:3] == b"BZh":
        return "bz2"
    if raw[:6] == b"\xfd7zXZ\x00":
        return "xz"
    return "zstd" if raw[:4] == b"\x28\xb5\x2f\xfd" else None


class _Source(io.RawIOBase):
    """Pieces of bytes as a file."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            if (more := next(self.pieces, None)) is None:
                return 0
            self.rest = more
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


class Unpacking:
    """The unpacked bytes of a compressed stream in bounded pieces, all its members; clean if nothing was left over or broken."""

    def __init__(self, kind: str, pieces: Iterator[bytes], notes: Notes) -> None:
        self.kind, self.source, self.notes, self.clean = kind, pieces, notes, True

    def __iter__(self) -> Iterator[bytes]:
        some = False
        try:
            for piece in self._zstd() if self.kind == "zstd" else self._members():
                some = some or bool(piece)
                yield piece
        except (zlib.error, zstandard.ZstdError, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError) as e:
            self.clean = False
            self.notes.unopened += some or "memory" in str(e).lower()

    def _zstd(self) -> Iterator[bytes]:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(io.BufferedReader(_Source(self.source)), read_across_frames=True) as reader:
            while piece := reader.read1(PIECE_BYTES):
                yield piece

    def _members(self) -> Iterator[bytes]:
        kind, data = self.kind, next(self.source, b"")
        while True:
            if kind in ("gzip", "zlib"):
                worker = zlib.decompressobj(31 if kind == "gzip" else 15)
            else:
                worker = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(memlimit=256 << 20)
            while True:
                out = worker.decompress(data, PIECE_BYTES)
                data = getattr(worker, "unconsumed_tail", b"")
                if out:
                    yield out
                if worker.eof:
                    break
                if not data and len(out) < PIECE_BYTES and getattr(worker, "needs_input", True) and not (data := next(self.source, b"")):
                    return
            data = worker.unused_data
            while len(data) < 6 and (more := next(self.source, b"")):
                data += more
            kind = _kind(data)
            if kind == "zstd":
                self.source = chain([data], self.source)
                yield from self._zstd()
                return
            if kind is None:
                self.clean = not data.strip(b"\0") and not any(x.strip(b"\0") for x in self.source)
                return


def _contents(raw: bytes, limit: int, notes: Notes) -> Iterator[bytes]:
    """raw with its compressed layers taken off: whole up to the limit, else in chunks; packed bytes too where not all unpacked."""
    seen: set[bytes] = set()
    while True:
        kind, key = _kind(raw), hashlib.sha1(raw).digest()
        if kind is None or key in seen:
            yield raw
            return
        seen.add(key)
        stream = Unpacking(kind, iter([raw]), notes)
        pieces, held = iter(stream), bytearray()
        for piece in pieces:
            held += piece
            if len(held) > limit:
                break
        else:
            if held and not stream.clean:
                yield raw
            if held:
                raw = bytes(held)
                continue
            yield raw
            return
        notes.unopened += 1
        pieces = chain([bytes(held)], pieces)
        for _ in range(MAX_NESTED):
            head = next(pieces, b"")
            pieces = chain([head], pieces)
            if (kind := _kind(head)) is None:
                break
            pieces = iter(Unpacking(kind, pieces, notes))
        yield from _chunks(pieces, min(limit, CHUNK_BYTES))
        if not stream.clean:
            yield raw
        return


def _chunks(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The bytes of all pieces in chunks of the size, each half in two of them."""
    held, step = bytearray(), max(size // 2, 1)
    for piece in pieces:
        held += piece
        at = 0
        while len(held) - at > size:
            yield bytes(held[at : at + size])
            at += step
        del held[:at]
    yield bytes(held)


def _texts(raw: bytes) -> Iterator[str]:
    """raw as UTF-8 text and, where it holds ASCII in 16-bit units, as UTF-16 of both orders and places."""
    if not raw:
        return
    yield raw.decode(errors="replace")
    if WIDE.search(raw):
        for at in (0, 1):
            for order in ("le", "be"):
                yield raw[at:].decode(f"utf-16-{order}", "replace")


def find_secrets(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list[tuple[str, int, int, int]], int]:
    """(kind, start, end, layer depth) of all spans in the original text, base ones at depth 0, and the layers not held or unpacked whole."""
    spans = {span: 0 for span in scan(text)}
    notes = Notes()
    escaped = "%" in text or "\\" in text or "&#" in text
    if escaped or CODED.search(text) or WRAPPED.search(text):
        base = Layer(text, 0)
        # Depth first, so that the chunks of a large layer are held one at a time; a layer found nearer the text is read again.
        seen = {base.digest(): 0}
        work = [base.inner(max_layer_bytes, notes)]
        while work:
            found = next(work[-1], None)
            if found is None:
                work.pop()
                continue
            key = found.digest()
            if seen.get(key, found.depth + 1) <= found.depth:
                continue
            seen[key] = found.depth
            for kind, a, b in scan(found.text):
                if found.touched(a, b):
                    span = (kind, *found.place(a, b))
                    spans[span] = min(found.depth, spans.get(span, found.depth))
            work.append(found.inner(max_layer_bytes, notes))
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, spans[s]) for s in order], notes.unopened


SPANS = "array<struct<kind:string,start:int,end:int,layer:int>>"


def secret_spans(docs: DataFrame, max_layer_bytes: int = MAX_LAYER_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, carried columns, spans ordered by start, kind and end, n_unopened."""
    small_batches(docs.sparkSession, 2000)
    carry = carry or []
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            found = [find_secrets(t, max_layer_bytes) for t in batch.column(0).to_pylist()]
            spans = pa.array([[dict(zip(("kind", "start", "end", "layer"), s, strict=True)) for s in spans] for spans, _ in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], spans, pa.array([n for _, n in found], pa.int32())], [*batch.schema.names[1:], "spans", "n_unopened"])

    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[1:]) + f", spans {SPANS}, n_unopened int"
    return slim.mapInArrow(batches, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """docs with every found span replaced by its kind's mark; overlapping spans merge into one, named by the first."""
    columns = docs.columns
    small_batches(docs.sparkSession, 2000)
    at = columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        parts, done = [], 0
        runs: list[list] = []
        for kind, a, b, _ in find_secrets(text)[0]:
            if runs and a < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([kind, a, b])
        for kind, a, b in runs:
            parts += [text[done:a], mark.format(kind=kind)]
            done = b
        return "".join([*parts, text[done:]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(batches, docs.schema)
