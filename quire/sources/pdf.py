"""PDF files to pages, and content streams to text operations.

A file is one row and is taken apart where it is read, as packages are; a content stream is one row. What the
operations of a page draw, and where, is worked out on Spark (`quire.operators.glyphs`).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.sources.packages import LIMITS, LimitError

#: Fixed values of the format: characters that end a word, operators that set text, advances in ems, the page without a box.
_END = rb"\x00\t\n\f\r ()<>\[\]{}/%"
TEXT_OPERATORS = frozenset("BT Tf TL Td TD Tm T* Tj TJ ' \"".split())
SPACE_EM, CHAR_EM = 0.3, 0.5
LETTER = (612.0, 792.0)

_TOKEN = re.compile(rb"(?P<skip>[\x00\t\n\f\r ]+|%[^\r\n]*)|(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\x00\t\n\f\r ]*)>|/(?P<name>[^" + _END + rb"]*)|(?P<mark>[\[\]])|(?P<string>\()|(?P<word>[^" + _END + rb"]+)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_IN_STRING = re.compile(rb"\\(?:\r\n|.)|[()]", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)|\r\n?", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_IMAGE_END = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ]|$)")


class Name(str):
    """A name, kept apart from operators."""


class Ref(int):
    """The number of an object that is referred to."""


def _unescape(m: re.Match[bytes]) -> bytes:
    what = m[1]
    if what is None:
        return b"\n"
    return bytes([int(what, 8) & 255]) if what[:1] in b"01234567" else _PLAIN.get(what, what)


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, Any, int]]:
    """(kind, value, end): number, string, name, mark or word. Bytes that begin no token are passed over; a string that does not end runs to the end."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if m is None:
            at += 1
            continue
        at, kind = m.end(), m.lastgroup
        if kind == "skip":
            continue
        if kind == "string":
            begin, depth = at, 1
            while depth:
                m = _IN_STRING.search(data, at)
                if m is None:
                    at = len(data) + 1
                    break
                at = m.end()
                depth += {b"(": 1, b")": -1}.get(m[0], 0)
            yield "string", _ESCAPE.sub(_unescape, data[begin : at - 1]), at
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif kind == "word":
            yield ("number", float(m[0]), at) if _NUMBER.fullmatch(m[0]) else ("word", m[0], at)
        else:
            yield ("name" if kind == "name" else "mark"), m[kind], at


def operations(data: bytes) -> Iterator[tuple[str, list[Any]]]:
    """Operators of a content stream with their operands: numbers, bytes, names and lists. Data of inline images is passed over."""
    at, operands, open_ = 0, [], []
    again = True
    while again:
        again = False
        for kind, value, end in tokens(data, at):
            if kind == "mark":
                if value in (b"[", b"<<"):
                    open_.append([])
                elif open_:
                    done = open_.pop()
                    (open_[-1] if open_ else operands).append(done)
                continue
            if kind == "word" and value not in (b"true", b"false", b"null"):
                if value == b"ID":
                    m = _IMAGE_END.search(data, end)
                    at, again = (m.end() if m else len(data)), True
                yield value.decode("latin-1"), operands
                operands, open_ = [], []
                if again:
                    break
            else:
                (open_[-1] if open_ else operands).append(Name(value.decode("latin-1")) if kind in ("name", "word") else value)


def _shown(op: str, operands: list[Any]) -> list[Any]:
    """Strings, and shifts in thousandths of an em, that an operator shows."""
    at = {"Tj": 0, "'": 0, "TJ": 0, '"': 2}.get(op)
    what = operands[at] if at is not None and len(operands) > at else None
    if op == "TJ":
        return what if isinstance(what, list) else []
    return [what] if isinstance(what, bytes) else []


def text_rows(data: bytes) -> Iterator[tuple[str, list[float], str, list[int], list[float], float]]:
    """(op, numbers, text, at, shift, advance) of operations on text.

    Operands that are no numbers count as 0. Bytes are characters of Latin-1; before the character `at` the place is
    shifted by `shift` ems, and the whole operation leads `advance` ems on.
    """
    for op, operands in operations(data):
        if op not in TEXT_OPERATORS:
            continue
        numbers = [x if isinstance(x, float) else 0.0 for x in operands]
        text, at, shift = "", [], []
        for piece in _shown(op, operands):
            if isinstance(piece, float):
                at.append(len(text))
                shift.append(-piece / 1000.0)
            elif isinstance(piece, bytes):
                text += piece.decode("latin-1")
        spaces = text.count(" ")
        yield op, numbers, text, at, shift, SPACE_EM * spaces + CHAR_EM * (len(text) - spaces) + sum(shift)


def ems(text: str, at: list[int], shift: list[float]) -> np.ndarray:
    """How far behind the place where an operation begins each of its characters stands, in ems."""
    lead = np.where(np.frombuffer(text.encode("latin-1"), np.uint8) == 32, SPACE_EM, CHAR_EM)
    moved = np.zeros(len(text) + 1)
    np.add.at(moved, np.asarray(at, int), shift)
    return np.cumsum(lead) - lead + np.cumsum(moved)[:-1]


#: Characters in a batch of operations.
BATCH = 1 << 16


def text_operations(streams: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """streams (by, content) to (by, seq, op, numbers, text, at, shift, advance); seq runs from 0 over a page's operations on text. A null stream has none."""
    rest = T.StructType.fromDDL("seq long, op string, numbers array<double>, text string, at array<int>, shift array<double>, advance double")
    schema = T.StructType([streams.schema[c] for c in by] + rest.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for *key, data in zip(*[batch.column(c).to_pylist() for c in [*by, content]], strict=True):
                for seq, row in enumerate(text_rows(data or b"")):
                    rows.append((*key, seq, *row))
                    chars += len(row[2]) + 16
                    if chars >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return streams.select(*by, content).mapInArrow(run, schema)


_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+obj\b")
_STREAM = re.compile(rb"[\x00\t\n\f\r ]*stream(?:\r\n|\n|\r)")

_STREAM_END = re.compile(rb"(?:\r\n|\n|\r)?endstream")
_REFERS = re.compile(rb"[\x00\t\n\f\r ]+(?:\d+[\x00\t\n\f\r ]+)?R\b")


def _value(data: bytes, at: int) -> tuple[Any, int]:
    """The object that begins at a place: dictionaries, lists, strings, names, numbers and references."""
    stack: list[tuple[bytes, list]] = [(b"", [])]
    for kind, value, end in tokens(data, at):
        at = end
        if kind == "mark" and value in (b"[", b"<<"):
            stack.append((value, []))
            continue
        items = stack[-1][1]
        if kind == "mark":
            if len(stack) == 1:
                break
            opened, items = stack.pop()
            stack[-1][1].append(items if opened == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)})
        elif kind == "word" and value == b"R" and len(items) >= 2:
            number = items[-2]
            items[-2:] = [Ref(int(number))]
        elif kind == "word" and value in (b"endobj", b"stream"):
            break
        else:
            items.append(Name(value.decode("latin-1")) if kind == "name" else value)
        if len(stack) == 1 and not (isinstance(stack[0][1][-1], float) and _REFERS.match(data, at)):
            break
    return (stack[0][1][-1] if stack[0][1] else None), at


class Pdf:
    """Objects of a file, found by their headers; the last of those with one number counts. Inflated under one budget."""

    def __init__(self, content: bytes):
        if len(content) > LIMITS["raw_bytes"]:
            raise LimitError("raw_bytes")
        if b"%PDF-" not in content[:1024]:
            raise ValueError("not a pdf")
        self.left = LIMITS["inflated_bytes"]
        self.data = content
        self.objects: dict[int, tuple[Any, bytes | None]] = {}
        at = 0
        while header := _OBJECT.search(content, at):
            value, at = _value(content, header.end())
            raw = None
            if isinstance(value, dict) and (s := _STREAM.match(content, at)):
                length = value.get("Length")
                stop = s.end() + int(length) if isinstance(length, float) else -1
                if stop < 0 or not _STREAM_END.match(content, stop):
                    m = _STREAM_END.search(content, s.end())
                    stop = m.start() if m else len(content)
                raw, at = content[s.end() : stop], stop
            self.objects[int(header[1])] = (value, raw)
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("encrypted")
        for value, raw in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and raw is not None:
                self._unpack(value, self._inflated(value, raw))

    def _unpack(self, head: dict, data: bytes) -> None:
        first = int(head.get("First", 0))
        pairs = [int(v) for kind, v, _ in tokens(data[:first]) if kind == "number"]
        for number, offset in zip(pairs[::2], pairs[1::2], strict=False):
            self.objects.setdefault(number, (_value(data, first + offset)[0], None))

    def _inflated(self, head: dict, raw: bytes) -> bytes:
        filters = self.get(head.get("Filter", []))
        for name in filters if isinstance(filters, list) else [filters]:
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name}")
            raw = zlib.decompressobj().decompress(raw, self.left + 1)
        self.left -= len(raw)
        if self.left < 0:
            raise LimitError("inflated_bytes")
        return raw

    def get(self, value: Any) -> Any:
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(int(value), (None, None))[0], seen + 1
        return value

    def stream(self, value: Any) -> bytes:
        """A stream, or the streams of a list with a line end between."""
        if isinstance(value, Ref):
            head, raw = self.objects.get(int(value), (None, None))
            return self.stream(head) if raw is None else self._inflated(head, raw)
        return b"\n".join(self.stream(v) for v in value) if isinstance(value, list) else b""

    def pages(self) -> Iterator[tuple[float, float, bytes]]:
        """(width, height, content) in the order of the page tree; a box comes from the nearest ancestor that has one."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo = [(roots[-1].get("Pages"), None)] if roots else []
        seen: set[int] = set()
        while todo:
            ref, box = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            own = self.get(node.get("MediaBox"))
            box = own if isinstance(own, list) and own else box
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, box) for k in reversed(kids)]
                continue
            sides = [v if isinstance(v, float) else 0.0 for v in map(self.get, box or [])]
            width, height = (abs(sides[2] - sides[0]), abs(sides[3] - sides[1])) if len(sides) == 4 else LETTER
            yield width, height, self.stream(node.get("Contents"))


def read_pages(files: DataFrame) -> DataFrame:
    """files (path, content) to (path, page, width, height, content, error), in points; pages run from 1. A file that cannot be read is one row with its error."""
    schema = T.StructType.fromDDL("path string, page int, width double, height double, content binary, error string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, n, *page, None) for n, page in enumerate(Pdf(content or b"").pages(), 1)]
                    if not rows:
                        raise ValueError("no pages")
                except (LimitError, ValueError, ArithmeticError, TypeError, zlib.error) as e:
                    rows = [(path, None, None, None, None, str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)
