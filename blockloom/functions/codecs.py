"""Binary formats: typed keys, manifests, manifest roots, block frames, frame streams, fixed records and chunked HTTP bodies.

All integers are big-endian. Encoders raise ``CodecError`` on values that the format can't hold, decoders on bytes that don't follow it
or are left over. The last functions lift them to tables; there a failed row has a null result and the message in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: numbers of the formats
KINDS = ("blob", "block", "chunk", "manifest", "view")
ALGOS = ("sha-256", "sha-1", "blake3")
FRAME_TYPES = ("block", "manifest", "attribute", "index")
FRAME_ALGORITHMS = ("plain", "compressed", "encrypted", "compressed_then_encrypted")
DIGEST_BYTES = {"sha-256": 32, "sha-1": 20, "blake3": 32}
VERSION, MAX_ENTRIES, MAX_ANNOTATIONS, MAX_PAGES = 1, 16384, 256, 65535


class CodecError(ValueError):
    pass


class NeedMore(CodecError):
    """The bytes end inside a value."""


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise NeedMore(f"needs {self.at + n - len(self.data)} more bytes")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, fmt: str) -> int:
        return struct.unpack(">" + fmt, self.take(struct.calcsize(">" + fmt)))[0]

    def text(self) -> str:
        try:
            return self.take(self.num("H")).decode()
        except UnicodeDecodeError as e:
            raise CodecError("text isn't UTF-8") from e

    def done(self) -> None:
        if self.at != len(self.data):
            raise CodecError(f"{len(self.data) - self.at} bytes left over")


def _text(s: str) -> bytes:
    b = s.encode()
    if len(b) > 0xFFFF:
        raise CodecError("text too long")
    return struct.pack(">H", len(b)) + b


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise CodecError(what)


@dataclass(frozen=True)
class Key:
    """A typed key; ``name``, ``args`` and ``scope`` belong to views, whose other fields are those of their base manifest key."""

    kind: str
    algo: str
    digest: str
    size: int
    name: str | None = None
    args: tuple[tuple[str, str], ...] = ()
    scope: str | None = None

    def check(self) -> Key:
        _check(self.kind in KINDS and self.algo in ALGOS, "unknown kind or algorithm")
        try:
            n = len(bytes.fromhex(self.digest))
        except ValueError:
            n = -1
        _check(n == DIGEST_BYTES[self.algo], f"invalid digest {self.digest!r}")
        _check(self.size > 0 if self.kind in ("blob", "block") else self.size >= 0, f"size {self.size} for a {self.kind}")
        return self


def encode_key(k: Key) -> bytes:
    k.check()
    out = bytes([KINDS.index(k.kind), ALGOS.index(k.algo)]) + _text(k.digest) + struct.pack(">Q", k.size)
    if k.kind == "view":
        out += _text(k.name or "") + struct.pack(">H", len(k.args)) + b"".join(_text(a) + _text(b) for a, b in sorted(k.args))
        out += b"\x00" if k.scope is None else b"\x01" + _text(k.scope)
    return out


def read_key(r: Reader) -> Key:
    kind, algo = r.num("B"), r.num("B")
    _check(kind < len(KINDS) and algo < len(ALGOS), f"unknown tag {kind}/{algo}")
    digest, size = r.text(), r.num("Q")
    if KINDS[kind] != "view":
        return Key(KINDS[kind], ALGOS[algo], digest, size).check()
    name = r.text()
    args = tuple((r.text(), r.text()) for _ in range(r.num("H")))
    _check(len({a for a, _ in args}) == len(args), "an argument occurs twice")
    flag = r.num("B")
    _check(flag < 2, f"invalid flag {flag}")
    return Key("view", ALGOS[algo], digest, size, name, args, r.text() if flag else None).check()


@dataclass(frozen=True)
class Entry:
    key: Key
    start: int
    end: int
    annotations: dict[str, str] = field(default_factory=dict)


def check_manifest(entries: list[Entry], size: int) -> None:
    """In order, without overlap; gaps are allowed; the size is the last end + 1."""
    last = -1
    for e in entries:
        _check(0 <= e.start <= e.end, f"invalid span {e.start}..{e.end}")
        _check(e.start > last, f"span {e.start}..{e.end} overlaps or is out of order")
        last = e.end
    _check(size == last + 1, f"size {size} isn't {last + 1}")


def encode_manifest(entries: list[Entry], size: int) -> bytes:
    _check(len(entries) <= MAX_ENTRIES, f"too many entries: {len(entries)}")
    check_manifest(entries, size)
    out = [struct.pack(">Bi", VERSION, len(entries))]
    for e in entries:
        _check(len(e.annotations) <= MAX_ANNOTATIONS, "too many annotations")
        out.append(encode_key(e.key) + struct.pack(">qqH", e.start, e.end, len(e.annotations)))
        out += [_text(k) + _text(v) for k, v in sorted(e.annotations.items())]
    return b"".join(out) + struct.pack(">q", size)


def decode_manifest(data: bytes) -> tuple[list[Entry], int]:
    r = Reader(data)
    v, n = r.num("B"), r.num("i")
    _check(v == VERSION, f"unsupported version {v}")
    _check(0 <= n <= MAX_ENTRIES, f"entry count {n}")
    entries = []
    for _ in range(n):
        key, start, end, k = read_key(r), r.num("q"), r.num("q"), r.num("H")
        _check(k <= MAX_ANNOTATIONS, f"too many annotations: {k}")
        pairs = [(r.text().strip(), r.text()) for _ in range(k)]
        _check(len({a for a, _ in pairs}) == k, "an annotation occurs twice")
        _check(all(1 <= len(a) <= 64 and len(b) <= 1024 for a, b in pairs), "an annotation's key or value has an invalid length")
        entries.append(Entry(key, start, end, dict(pairs)))
    size = r.num("q")
    r.done()
    check_manifest(entries, size)
    return entries, size


@dataclass(frozen=True)
class Page:
    key: Key
    start: int
    end: int
    entries: int


def check_root(pages: list[Page], size: int) -> None:
    for p in pages:
        _check(p.key.kind == "manifest", "a page's key must be a manifest key")
        _check(0 < p.entries <= 0xFFFF, f"entry count {p.entries}")
    check_manifest([Entry(p.key, p.start, p.end) for p in pages], size)


def encode_root(pages: list[Page], size: int) -> bytes:
    _check(len(pages) <= MAX_PAGES, f"too many pages: {len(pages)}")
    check_root(pages, size)
    body = b"".join(encode_key(p.key) + struct.pack(">qqH", p.start, p.end, p.entries) for p in pages)
    return struct.pack(">Bi", VERSION, len(pages)) + body + struct.pack(">q", size)


def decode_root(data: bytes) -> tuple[list[Page], int]:
    r = Reader(data)
    v, n = r.num("B"), r.num("i")
    _check(v == VERSION, f"unsupported version {v}")
    _check(0 <= n <= MAX_PAGES, f"page count {n}")
    pages = [Page(read_key(r), r.num("q"), r.num("q"), r.num("H")) for _ in range(n)]
    size = r.num("q")
    r.done()
    check_root(pages, size)
    return pages, size


class _Bits:
    """A bit string: flags of the frame format are single bits, so later fields needn't start on a byte."""

    def __init__(self, value: int = 0, n: int = 0):
        self.value, self.n = value, n

    def put(self, value: int, bits: int) -> _Bits:
        self.value, self.n = (self.value << bits) | (value & ((1 << bits) - 1)), self.n + bits
        return self

    def put_bytes(self, b: bytes) -> _Bits:
        return self.put(int.from_bytes(b, "big"), 8 * len(b)) if b else self

    def to_bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


class _BitReader:
    """Reads only the bytes it is asked for, so a frame's cost is its own size whatever follows it in the buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.total, self.at = memoryview(data), 8 * len(data), at

    def get(self, bits: int) -> int:
        if self.at + bits > self.total:
            raise NeedMore(f"needs {self.at + bits - self.total} more bits")
        first, end = self.at // 8, -(-(self.at + bits) // 8)
        self.at += bits
        return (int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at)) & ((1 << bits) - 1)

    def get_bytes(self, n: int) -> bytes:
        return self.get(8 * n).to_bytes(n, "big") if n else b""


@dataclass(frozen=True)
class Frame:
    payload: bytes
    frame_type: str = "block"
    algorithm: str = "plain"
    version: int = 1
    key_id: str | None = None
    nonce: bytes | None = None
    org_id: str | None = None
    blob_key: Key | None = None
    block_index: int | None = None
    policy_tag: str | None = None
    extra: tuple[tuple[str, str], ...] = ()
    tag: bytes | None = None


def _opt_text(b: _Bits, s: str | None) -> None:
    b.put(s is not None, 1)
    if s is not None:
        b.put_bytes(_text(s))


def _opt_bytes(b: _Bits, s: bytes | None) -> None:
    b.put(s is not None, 1)
    if s is not None:
        _check(len(s) <= 0xFFFF, "too long")
        b.put(len(s), 16).put_bytes(s)


def _aad(f: Frame) -> _Bits:
    b = _Bits()
    _opt_text(b, f.org_id)
    b.put(f.blob_key is not None, 1)
    if f.blob_key is not None:
        b.put_bytes(encode_key(f.blob_key))
    b.put(f.block_index is not None, 1)
    if f.block_index is not None:
        b.put(f.block_index, 64)
    _opt_text(b, f.policy_tag)
    b.put(len(f.extra), 16)
    for k, v in f.extra:
        b.put_bytes(_text(k) + _text(v))
    return b


def encode_frame(f: Frame) -> bytes:
    aad = _aad(f)
    b = _Bits().put(f.version, 8).put(FRAME_TYPES.index(f.frame_type), 8).put(FRAME_ALGORITHMS.index(f.algorithm), 8)
    b.put(len(f.payload), 64).put(len(aad.to_bytes()), 32)
    _opt_text(b, f.key_id)
    _opt_bytes(b, f.nonce)
    b.put(aad.value, aad.n).put(len(f.payload), 64).put_bytes(f.payload)
    _opt_bytes(b, f.tag)
    return b.to_bytes()


def decode_frame(data: bytes) -> tuple[Frame, int]:
    """The first frame and the bytes it takes."""
    r = _BitReader(data)
    version, ft, alg = r.get(8), r.get(8), r.get(8)
    _check(ft < len(FRAME_TYPES) and alg < len(FRAME_ALGORITHMS), f"unknown frame type or algorithm {ft}/{alg}")
    n, aad_len = r.get(64), r.get(32)
    _check(n < 1 << 63 and aad_len < 1 << 31, "a length is negative")
    text = lambda: r.get_bytes(r.get(16)).decode() if r.get(1) else None
    blob = lambda: r.get_bytes(r.get(16)) if r.get(1) else None
    key_id, nonce = text(), blob()
    org = text()
    key = None
    if r.get(1):
        kr = Reader(r.get_bytes((r.total - r.at) // 8))
        key = read_key(kr)
        r.at -= 8 * (len(kr.data) - kr.at)
    index = r.get(64) if r.get(1) else None
    if index is not None and index >= 1 << 63:
        index -= 1 << 64
    policy = text()
    extra = tuple((r.get_bytes(r.get(16)).decode(), r.get_bytes(r.get(16)).decode()) for _ in range(r.get(16)))
    payload = r.get_bytes(r.get(64))
    f = Frame(payload, FRAME_TYPES[ft], FRAME_ALGORITHMS[alg], version, key_id, nonce, org, key, index, policy, extra, blob())
    _check(len(_aad(f).to_bytes()) == aad_len, "length of the additional data differs")
    _check(len(payload) == n, "length of the payload differs")
    return f, -(-r.at // 8)


def frame_block(payload: bytes, layout: str = "plain", **fields: Any) -> Frame:
    """A frame for a block. Only the plain layout exists; others are refused rather than written wrongly."""
    if layout != "plain":
        raise NotImplementedError(f"layout {layout}")
    return Frame(payload, **fields)


def decode_stream(chunks: list[bytes], decode: Callable[[bytes], tuple[Any, int]], many: bool = True, strict: bool = True) -> list[Any]:
    """Values decoded across chunk borders. An incomplete value waits for more bytes. ``many`` goes on after the first value and asks
    for progress. At an error, ``strict`` raises and the tolerant form stops with what it has; so too for bytes left at the end."""
    out, buf, active = [], b"", True
    for c in chunks:
        buf += c
        while active and buf:
            try:
                value, used = decode(buf)
            except NeedMore:
                break
            except CodecError:
                if strict:
                    raise
                return out
            if used <= 0:
                raise CodecError("a decoder made no progress")
            out.append(value)
            buf = buf[used:]
            active = many
    if buf and many and strict:
        raise NeedMore("the stream ends inside a value")
    return out


def fixed_records(chunks: list[bytes], size: int) -> tuple[list[bytes], bytes]:
    """(records of ``size`` bytes, what is left over)"""
    if size < 1:
        raise CodecError("record size must be positive")
    data = b"".join(chunks)
    whole = len(data) - len(data) % size
    return [data[i : i + size] for i in range(0, whole, size)], data[whole:]


def http_chunks(data: bytes) -> list[bytes]:
    """The chunks of an HTTP/1.1 chunked body, extensions and trailers skipped."""
    out, at, n = [], 0, len(data)
    while True:
        eol = data.find(b"\r\n", at)
        if eol < 0:
            raise CodecError("the body ends before the line of a chunk's size")
        line = data[at:eol].split(b";", 1)[0].replace(b"\r", b"").replace(b"\n", b"").decode("ascii", "replace").strip()
        try:
            size = int(line, 16) if "_" not in line else -1
        except ValueError:
            size = -1
        if size < 0:
            raise CodecError(f"no chunk size: {line!r}")
        at = eol + 2
        if size == 0:
            while True:
                eol = data.find(b"\r\n", at)
                if eol < 0:
                    raise CodecError("the body ends before the empty line after its trailers")
                if eol == at:
                    return out
                at = eol + 2
        if at + size > n:
            raise CodecError("the body ends inside a chunk")
        body, at = data[at : at + size], at + size
        for char, name in ((b"\r", "CR"), (b"\n", "LF")):
            if at >= n:
                raise CodecError("the body ends before a chunk's line end")
            if data[at : at + 1] != char:
                raise CodecError(f"no {name} behind a chunk")
            at += 1
        out.append(body)


def decoded(df: DataFrame, keys: list[str], data: str, fn: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(keys..., parts, error) of a function from bytes to parts, batch by batch; null data gives nulls."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, errors = [], []
            for d in b.column(len(keys)).to_pylist():
                try:
                    parts.append(None if d is None else fn(bytes(d)))
                    errors.append(None)
                except CodecError as e:
                    parts.append(None)
                    errors.append(str(e))
            yield pa.record_batch([*(b.column(i) for i in range(len(keys))), pa.array(parts, pa.list_(pa.binary())), pa.array(errors, pa.string())], [*keys, "parts", "error"])

    return df.select(*keys, F.col(data).cast("binary").alias("__d")).mapInArrow(run, f"{types}, parts array<binary>, error string")


def manifest_frames(entries: DataFrame, blob: str) -> DataFrame:
    """(blob, page, frame, entries, error): pages of MAX_ENTRIES entries each, encoded. ``entries`` has blob, ordinal, algo, digest,
    size, start, end. A page's spans start anew at its own first byte."""
    d = entries.withColumn("page", F.floor(F.col("ordinal") / MAX_ENTRIES).cast("int"))
    g = d.groupBy(blob, "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "algo", "digest", "size", "start", "end"))).alias("e"))
    kind = g.schema[blob].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames, errors = [], []
            for es in b.column(2).to_pylist():
                base = es[0]["start"]
                try:
                    xs = [Entry(Key("block", e["algo"], e["digest"], e["size"]), e["start"] - base, e["end"] - base) for e in es]
                    frames.append(encode_manifest(xs, es[-1]["end"] - base + 1))
                    errors.append(None)
                except CodecError as e:
                    frames.append(None)
                    errors.append(str(e))
            n = [len(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(frames, pa.binary()), pa.array(n, pa.int32()), pa.array(errors, pa.string())], [blob, "page", "frame", "entries", "error"])

    return g.mapInArrow(run, f"`{blob}` {kind}, page int, frame binary, entries int, error string")


def manifest_roots(pages: DataFrame, blob: str) -> DataFrame:
    """(blob, root, size): one root a blob over its pages, each named by the hash and length of its frame. ``pages`` has blob, page,
    frame, entries, start, end in the blob's own bytes; a blob whose pages don't follow each other is an error."""
    from blockloom.operators.transduce import fold_emit

    def machine(rows):
        got = [Page(Key("manifest", "sha-256", hashlib.sha256(frame).hexdigest(), len(frame)), start, end, n) for frame, n, start, end in rows]
        size = got[-1].end + 1
        yield encode_root(got, size), size

    return fold_emit(pages, [blob], ["page"], ["frame", "entries", "start", "end"], "root binary, size bigint", machine)


def root_pages(roots: DataFrame, blob: str) -> DataFrame:
    """(blob, page, digest, frame_bytes, start, end, entries) of decoded roots: what to read, and how to check it."""
    from blockloom.operators.transduce import fold_emit

    def machine(rows):
        for (root,) in rows:
            for k, p in enumerate(decode_root(bytes(root))[0]):
                yield k, p.key.digest, p.key.size, p.start, p.end, p.entries

    return fold_emit(roots, [blob], [blob], ["root"], "page int, digest string, frame_bytes bigint, `start` bigint, `end` bigint, entries int", machine)
