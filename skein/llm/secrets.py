"""Secret scan with a recursive decoding worklist.

Every text is scanned for three kinds of secret (:data:`KINDS`).  Then its
encoded parts are unwrapped: URL escapes, Unicode escapes, base64 (of UTF-8 or
UTF-16, beginning at any character of a run) and, inside base64, zlib, gzip or
raw deflate streams, whatever they begin with.  What can't be decoded inside a
layer, such as a bad byte or a control character, becomes U+FFFD and the rest
is kept; a stream that is broken is read as far as it goes.  Each unwrapped layer goes on a worklist, is
scanned in turn and unwrapped further until nothing new appears.  A layer that
was seen before (by its content) is not opened again, which ends cycles.  Each
layer remembers where its characters come from, so that a span found in it is
given as the span of the original text that encodes it.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches

ASSIGN, ACCESS, HEX = range(3)
# The kinds of secret, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
# The patterns of the kinds and the least length of the match (assign: of its second group).
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the least length may stand in the pattern
_MIN_ASSIGN, _MIN_ACCESS = 12, 18

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNI = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# a run that goes on over line breaks, and its lines
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
# after one of these a payload may begin inside a run
_MARK = re.compile(r"[+/_-]")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
# after this no secret and no encoded run goes on
_END = re.compile(r"(?:[^A-Za-z0-9+/_\s-]|\n)[\x20\t\r]*\n")
#: Bytes inflated at a time, and the least characters of a piece of an inflated layer.
_PIECE = 1 << 20
# compressed bytes that are read at a time, and those after which what inflates without an error is no chance
_STEP, _SURE = 1 << 10, 1 << 9
# a hexadecimal run of fewer different digits may be a copy made by what only looks like a stream
_DIGITS = 6

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind, end) of every secret, leftmost and non-overlapping within a kind."""
    out = [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    out += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# bytes that may hold a secret or a further layer; every one of these is longer
_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
_TEXT_16 = {"utf-16-le": re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){16}"), "utf-16-be": re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){16}")}


def _clean(s: str) -> str:
    """``s`` with U+FFFD for every character that is neither printable nor white space."""
    if s.isprintable():
        return s
    return "".join(c if c.isprintable() or c in "\n\r\t" else "\ufffd" for c in s)


def _legible(raw: bytes) -> Iterator[tuple[str, np.ndarray, int]]:
    """The texts that ``raw`` may be, with the width in bytes of each character, and where they begin."""
    if _TEXT.search(raw):
        s = raw.decode("utf-8", "surrogateescape")
        width = np.ones(len(s), np.int64) if s.isascii() else np.array([1 if "\ud800" <= c <= "\udfff" else len(c.encode()) for c in s])
        yield _clean(s), width, 0
    for name, first in sorted(_wide(raw)):
        even = raw[first : first + (len(raw) - first) // 2 * 2]
        s = even.decode(name, "surrogatepass")
        yield _clean(s), np.array([4 if c > "\uffff" else 2 for c in s]), first


def _wide(raw: bytes) -> set[tuple[str, int]]:
    """The kinds of UTF-16 that ``raw`` may hold, and whether its characters begin at even or odd places; it may change along the way."""
    found: set[tuple[str, int]] = set()
    if b"\0" not in raw:
        return found
    for name, pattern in _TEXT_16.items():
        for m in pattern.finditer(raw):
            found.add((name, m.start() % 2))
            if {(name, 0), (name, 1)} <= found:
                break
    return found


def _streams(raw: bytes, run: str, off: int) -> Iterator[tuple[int, int]]:
    """(begin, window bits) of what may be compressed streams: gzip anywhere, the others where the run or a part of it behind a mark begins."""
    at = raw.find(b"\x1f\x8b\x08")
    while at >= 0:
        yield at, 31
        at = raw.find(b"\x1f\x8b\x08", at + 1)
    if off == 0:
        yield from _headed(raw, 0)
    for m in _MARK.finditer(run, max(0, off - 1)):
        if (m.end() - off) % 4 == 0:
            yield from _headed(raw, (m.end() - off) // 4 * 3)


def _headed(raw: bytes, at: int) -> Iterator[tuple[int, int]]:
    if len(raw) > at + 2 and raw[at] == 0x78 and (raw[at] << 8 | raw[at + 1]) % 31 == 0:
        yield at, 15
    # a raw deflate block of fixed or dynamic codes
    elif len(raw) > at + 8 and raw[at] >> 1 & 3 in (1, 2) and raw[at : at + 2] != b"\x1f\x8b":
        yield at, -15


def _inflated(raw: bytes, bits: int, left: list[int] | None = None) -> Iterator[bytes]:
    """The content of a compressed stream in bounded parts, for gzip one member after another; a broken stream ends where it breaks.

    ``left`` is told how many bytes come after what was read in full.
    """
    left = [] if left is None else left
    left[:] = [len(raw)]
    while raw and (bits != 31 or raw[:2] == b"\x1f\x8b"):
        stream, at, step = zlib.decompressobj(bits), 0, b""
        while not stream.eof:
            if not step:
                step = raw[at : at + _STEP]
                at += len(step)
            before = stream.copy()
            try:
                part = stream.decompress(step, _PIECE)
            except zlib.error:
                yield _unbroken(before, step)
                return
            yield part
            step = stream.unconsumed_tail
            if not (part or step or at < len(raw)):
                break
        raw = stream.unused_data + raw[at:]
        left[:] = [len(raw)]
        if bits != 31:
            return


def _unbroken(stream, step: bytes) -> bytes:
    """What ``stream`` makes of ``step`` before it breaks; a call that meets the break would return nothing."""
    out = bytearray()
    try:
        for i in range(len(step)):
            part = stream.decompress(step[i : i + 1], 1)
            while part:
                out += part
                part = stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error:
        pass
    return bytes(out)


def _opens(raw: bytes, begin: int, bits: int) -> tuple[bool, bool]:
    """Whether a stream that may hold a secret begins there, and whether it surely is one.

    What it holds needs not begin as text.  gzip, a checksum that fits and
    ``_SURE`` bytes without an error are proof enough.  Much that is shorter
    looks like a stream by chance, so there all that it holds is read: it is
    surely a stream if that is text for the most part, and if it breaks, text
    of more than the few characters that chance spells out and copies.
    """
    head = raw[begin : begin + _SURE]
    stream = zlib.decompressobj(bits)
    try:
        out, whole = stream.decompress(head), True
    except zlib.error:
        out, whole = _unbroken(zlib.decompressobj(bits), head), False
    if bits == 31:
        return whole or bool(out), True
    if whole and (bits > 0 if stream.eof else len(raw) - begin > _SURE):
        return True, True
    text = _clean(out.decode("utf-8", "replace"))
    plain = text.count("\ufffd") <= len(text) * (0.2 if bits > 0 else 0.05)
    return len(out) >= 16, plain and (whole or len(set(text)) >= 16)


def _pieces(raw: bytes, bits: int, left: list[int] | None = None, encoding: str = "utf-8", first: int = 0, wide: set[tuple[str, int]] | None = None) -> Iterator[str]:
    """The text of an inflated layer, from its byte ``first`` on, in pieces that no secret or encoded run straddles; a piece without such an end goes on.

    ``wide`` is told of the UTF-16 that the layer may hold.
    """
    decoder, parts, size = codecs.getincrementaldecoder(encoding)("replace"), [], 0
    tail, done = b"", 0
    for part in _inflated(raw, bits, left):
        if wide is not None:
            wide |= {(name, (i + done - len(tail)) % 2) for name, i in _wide(tail + part)}
            tail, done = (tail + part)[-32:], done + len(part)
        part, first = part[first:], max(0, first - len(part))
        parts.append(_clean(decoder.decode(part)))
        size += len(parts[-1])
        if size < _PIECE:
            continue
        # an end may lie across the parts
        text = "".join(parts)
        at = max((m.end() for m in _END.finditer(text, max(0, len(text) - 2 * _PIECE))), default=0)
        if at:
            yield text[:at]
            text = text[at:]
        parts, size = [text], 0
    parts.append(_clean(decoder.decode(b"", True)))
    yield "".join(parts)


def _texts(raw: bytes, bits: int, left: list[int]) -> Iterator[str]:
    """The pieces of an inflated layer as UTF-8, then as each kind of UTF-16 that it may hold."""
    wide: set[tuple[str, int]] = set()
    yield from _pieces(raw, bits, left, wide=wide)
    for encoding, first in sorted(wide):
        yield from _pieces(raw, bits, None, encoding, first)


def _wrapped(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs wrapped over lines, joined, and the places of their characters.

    Lines of a run are of one width, but for the first, which may begin behind
    other text, and the last, which is shorter.  Words of prose at the ends of
    lines look like parts of a run, so one is tried from each line at which
    the width changes, with the shorter last line and without it.
    """
    for m in _WRAPPED.finditer(text):
        runs = [(r.start(), r.end()) for r in _RUN.finditer(text, m.start(), m.end())]
        width = [b - a for a, b in runs]
        for i in range(len(runs) - 1):
            if i and width[i] == width[i - 1]:
                continue
            j = i + 1
            while j < len(runs) and width[j] == width[i + 1]:
                j += 1
            # the second line may be the last, shorter one
            for end in {j, min(j + 1, len(runs)) if j < len(runs) and width[j] < width[i + 1] else j}:
                tail = text[runs[end - 1][1] : m.end()] if end == len(runs) else ""
                body = "".join(text[a:b] for a, b in runs[i:end])
                if len(body) >= 16:
                    yield body + tail, np.concatenate([*(np.arange(a, b) for a, b in runs[i:end]), np.arange(m.end() - len(tail), m.end())])


def _escapes(line: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The line with its escapes replaced, and for each of its characters where its source starts and ends."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(line):
        got = decode(m[0])
        if got is None:
            continue
        plain = np.arange(at, m.start())
        parts.append(line[at : m.start()])
        starts.append(plain)
        ends.append(plain + 1)
        for s, a, b in got:
            parts.append(s)
            starts.append(np.full(len(s), m.start() + a))
            ends.append(np.full(len(s), m.start() + b))
        at = m.end()
    if not at:
        return None
    plain = np.arange(at, len(line))
    return "".join([*parts, line[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _url(run: str) -> list[tuple[str, int, int]] | None:
    s = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    out, at = [], 0
    for c in s:
        bad = "\ud800" <= c <= "\udfff"
        n = 3 if bad else 3 * len(c.encode())
        out.append(("\ufffd" if bad else c, at, at + n))
        at += n
    return out


def _uni(run: str) -> list[tuple[str, int, int]] | None:
    width = {"u": 6, "U": 10, "x": 4}[run[1]]
    units = [int(run[i + 2 : i + width], 16) for i in range(0, len(run), width)]
    out, i = [], 0
    while i < len(units):
        u, n = units[i], 1
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
        out.append(("\ufffd" if 0xD800 <= u < 0xE000 or u > 0x10FFFF else chr(u), i * width, (i + n) * width))
        i += n
    return out


def _layers(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """What one step of unwrapping finds in ``text``, with the sources of the characters, and whether it surely is a layer.

    Escapes are replaced in the context of their line, since a key may stand
    plain beside an escaped value; base64 is opened run by run, and where runs
    go on over line breaks, as a whole too.
    """
    for pattern, decode in ((_URL, _url), (_UNI, _uni)):
        done = -1
        for m in pattern.finditer(text):
            if m.start() < done:
                continue
            begin, done = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            done = len(text) if done < 0 else done
            if got := _escapes(text[begin:done], pattern, decode):
                yield got[0], got[1] + begin, got[2] + begin, True
    runs = ((m[0], np.arange(m.start(), m.end())) for m in _B64.finditer(text))
    for run, at in itertools.chain(runs, _wrapped(text)):
        body = run.rstrip("=").translate(_TO_STANDARD)
        # what a stream that was read to its end takes up is nothing else
        taken = [(0, 0)]
        for off, raw in _aligned(body, 0, len(body)):
            for begin, bits in _streams(raw, body, off):
                first, left = off + begin * 4 // 3, []
                if any(i <= first < j for i, j in taken):
                    continue
                opens, sure = _opens(raw, begin, bits)
                if opens:
                    for s in _texts(raw[begin:], bits, left):
                        yield s, np.full(len(s), at[first]), np.full(len(s), at[-1] + 1), sure
                    if sure and left[0] < len(raw) - begin:
                        taken.append((first, off + -(-(len(raw) - left[0]) * 4 // 3)))
        taken = sorted(taken)
        for (_, i), (j, _) in zip(taken, [*taken[1:], (len(body), 0)], strict=True):
            for off, raw in _aligned(body, i, j):
                for s, width, begin in _legible(raw):
                    end = begin + np.cumsum(width)
                    yield s, at[off + (end - width) * 4 // 3], at[np.minimum(off + (end * 4 + 2) // 3, len(run)) - 1] + 1, True


def _aligned(body: str, i: int, j: int) -> Iterator[tuple[int, bytes]]:
    """Characters i to j decoded, from each of the first four on: a payload may begin at any character."""
    for off in range(i, i + 4):
        end = j - ((j - off) % 4 == 1)
        if end - off < 16:
            return
        yield off, base64.b64decode(body[off:end] + "=" * (-(end - off) % 4))


_TO_STANDARD = str.maketrans("-_", "+/")


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and those with what its layers hold.

    Spans are (start, kind, end).  A compressed layer is inflated and scanned
    piece by piece, all of it, and opened depth first, so that a small text
    can't fill the memory.
    """
    base = scan(text)
    found = set(base)
    seen = {hashlib.blake2b(text.encode(), digest_size=16).digest()}
    work = [(_layers(text), None, None, True)]
    while work:
        layers, start, end, known = work[-1]
        if (layer := next(layers, None)) is None:
            work.pop()
            continue
        s, a, b, sure = layer
        sure &= known
        if not s:
            continue
        key = hashlib.blake2b(s.encode(), digest_size=16).digest()
        # the same layer at two places of the text is two layers; the same layer inside itself is a cycle
        a, b = (a, b) if start is None else (start[a], end[b - 1])
        if (key, int(a[0])) in seen:
            continue
        seen.add((key, int(a[0])))
        found |= {(int(a[i]), k, int(b[j - 1])) for i, k, j in scan(s) if sure or k != HEX or len(set(s[i:j])) >= _DIGITS}
        work.append((_layers(s), a, b, sure))
    return base, sorted(found)


def joined(of: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in of)


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the text's own spans, their digest and all spans.

    A null text counts as empty.  Every row comes back, repeated rows too;
    columns of ``docs`` with the names of the new ones are replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ': ') for x in _SCHEMA.split(', '))}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = spans(t or "")
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kept = [c for c in docs.columns if c not in new]
    return docs.select(*kept, find(F.col(text)).alias("_s")).select(*kept, *[f"_s.{c}" for c in new])
