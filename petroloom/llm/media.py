"""Media columns: bytes in progressive JPEG, read back by accumulating its scans.

The stored form keeps a payload losslessly in the format's own unit, the quantised coefficient:
byte b is the coefficient 256 + b, in zigzag order, 64 to a block, 4:2:0 (four Y blocks, one Cb, one Cr
to a 16 x 16 pixel unit), all quantisers 1. Its 21 scans are first passes over DC and over two spectral
bands of AC without their two lowest bits, then refinements of one bit each. A COM segment has
the payload's length.

The decoder reads any progressive JPEG of one or three components: parse() takes the file apart, and
each scan adds its bits to coefficient arrays. Where a scan's Huffman table has one code only, the place
of every bit follows from the headers, and whole batches of files are decoded with numpy at once; a
scan of any other kind goes through the general, bit by bit decoder. The inverse transform is one
matrix product with whole-number entries, exact in doubles, so equal files give equal pixels on
any machine. Chroma is repeated up to full resolution and RGB comes in bands of rows.

Nulls: a null text is an empty one; every text has a payload of 192 bytes or more. Repeated rows
are handled as any other; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from petroloom.llm import shared

UNIT = 192  # payloads are padded to a multiple
PAD = b" "
BATCH = 1 << 21  # bytes of text that are worked on at once
BAND = 1 << 20  # pixels of a band

ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _basis(bits: int = 14) -> np.ndarray:
    """Row: coefficient in zigzag order; column: pixel; whole numbers, scaled by 2^bits."""
    n = np.arange(8)
    wave = [[(np.sqrt(0.5) if k == 0 else 1.0) / 2 * np.cos((2 * n + 1) * k * np.pi / 16) for k in range(8)]][0]
    return np.rint(np.stack([np.outer(wave[y], wave[x]).ravel() for y, x in ZIGZAG]) * 2**bits)


_BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table whose only code is a single 0 bit."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


_HEAD = _segment(0xDB, bytes([0, *[1] * 64]))
_TABLES = _table(0, 0, 7) + _table(1, 0, 7) + _table(1, 1, 0) + _segment(0xDD, b"\x00\x01")
#: (stream, first and last coefficient, bits before and now): the scans after the first three.
_PASSES = (("low", 1, 5, 0, 2), ("high", 6, 63, 0, 2), ("ac1", 1, 63, 2, 1), ("dc1", 0, 0, 2, 1), ("ac0", 1, 63, 1, 0), ("dc0", 0, 0, 1, 0))


def _sos(component: int, first: int, last: int, high: int, low: int) -> bytes:
    ac_table = 1 if high and first else 0
    return _segment(0xDA, bytes([1, component + 1, ac_table, first, last, high << 4 | low]))


_SOS_DC = [_sos(c, 0, 0, 0, 2) for c in range(3)]
_SOS = {p: [_sos(c, *p[1:]) for c in range(3)] for p in _PASSES}
_RESTARTS = b"".join(bytes([0, 0xFF, 0xD0 + k]) for k in range(8))


def _shape(units: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 pixel units that hold so many."""
    columns = max(1, int(np.ceil(np.sqrt(units))))
    return columns, max(1, -(-units // columns))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files, one for each payload."""
    shapes = [_shape(-(-len(p) // 384)) for p in payloads]
    units = [w * h for w, h in shapes]
    b = np.frombuffer(b"".join(p.ljust(384 * u, b"\0") for p, u in zip(payloads, units, strict=True)), np.uint8).reshape(-1, 64)
    dc = np.frombuffer(_RESTARTS * (len(b) // 8 + 1), np.uint8)[: 3 * len(b)].reshape(-1, 3)
    top = b >> 2 | 0x40
    streams = {"low": np.ascontiguousarray(top[:, 1:6]), "high": np.ascontiguousarray(top[:, 6:])}
    for k in (1, 0):
        bits = (b >> k & 1).astype(np.uint8)
        streams[f"dc{k}"] = bits[:, 0].copy()
        bits[:, 0] = 0  # the code of the end of the band, before 63 correction bits
        streams[f"ac{k}"] = np.packbits(bits, axis=1)
    out, at = [], 0
    for payload, (w, h), n in zip(payloads, shapes, units, strict=True):
        spans = [(at, at + 4 * n), (at + 4 * n, at + 5 * n), (at + 5 * n, at + 6 * n)]
        at += 6 * n
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _HEAD, _segment(0xC2, frame), _TABLES]
        for c, (i, j) in enumerate(spans):
            scan = dc[: j - i].copy()
            scan[:, 0] = top[i:j, 0]
            parts += [_SOS_DC[c], scan.tobytes()[:-2]]
        parts.append(b"\xff\xdd\x00\x04\x00\x00")
        for p in _PASSES:
            s = streams[p[0]]
            for c, (i, j) in enumerate(spans):
                if p[0][:2] == "dc":
                    raw = np.packbits(np.concatenate([s[i:j], np.ones(-(j - i) % 8, np.uint8)])).tobytes()
                else:
                    raw = s[i:j].tobytes()
                parts += [_SOS[p][c], raw.replace(b"\xff", b"\xff\x00") if p[3] else raw]
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


@dataclass
class Scan:
    components: tuple[int, ...]
    tables: tuple[tuple[bytes | None, bytes | None], ...]  # DC and AC, as in their DHT segments
    first: int
    last: int
    high: int
    low: int
    restart: int
    data: bytes

    @property
    def kind(self) -> tuple:
        return self.components, self.tables, self.first, self.last, self.high, self.low, self.restart


@dataclass
class File:
    width: int = 0
    height: int = 0
    sampling: tuple[tuple[int, int], ...] = ()
    quantisers: tuple[bytes, ...] = ()
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)

    def blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns of a component's blocks, those of whole units."""
        (hm, vm), (h, v) = map(max, zip(*self.sampling, strict=True)), self.sampling[c]
        return -(-self.height // (8 * vm)) * v, -(-self.width // (8 * hm)) * h

    def own_blocks(self, c: int) -> tuple[int, int]:
        """Those that a scan of this component alone has."""
        (hm, vm), (h, v) = map(max, zip(*self.sampling, strict=True)), self.sampling[c]
        return -(-(-(-self.height * v // vm)) // 8), -(-(-(-self.width * h // hm)) // 8)


_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def parse(data: bytes) -> File:
    """The headers and scans of a progressive JPEG file."""
    f, at, restart = File(), 2, 0
    huffman: dict[int, bytes] = {}
    quantisers: dict[int, bytes] = {}
    names: list[int] = []
    used: list[int] = []
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            n = body[0]
            which = tuple(names.index(body[1 + 2 * k]) for k in range(n))
            tables = tuple((huffman.get(body[2 + 2 * k] >> 4), huffman.get(16 | body[2 + 2 * k] & 15)) for k in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at).start()
            f.scans.append(Scan(which, tables, first, last, bits >> 4, bits & 15, restart, data[at:end]))
            at = end
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = body[k + 1 : k + 65] if not wide else bytes(min(255, x) for x in struct.unpack(">64H", body[k + 1 : k + 129]))
                k += 65 + 64 * wide
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xC2:
            _, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            names = [body[6 + 3 * k] for k in range(n)]
            f.sampling = tuple((body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n))
            used = [body[8 + 3 * k] for k in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive files with Huffman codes are read")
    f.quantisers = tuple(quantisers[k] for k in used)
    return f


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + b"\xff" * 4, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(table: bytes | None) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 16
    for length, n in enumerate((table or b"")[:16], 1):
        for _ in range(n):
            out[length, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _general(f: File, s: Scan, planes: list[np.ndarray]) -> None:
    """Adds one scan, bit by bit, to planes[c][row, column, zigzag]."""
    if len(s.components) == 1:
        c = s.components[0]
        rows, columns = f.own_blocks(c)
        order = [[(0, c, y, x)] for y in range(rows) for x in range(columns)]
    else:
        (hm, vm) = map(max, zip(*f.sampling, strict=True))
        units = -(-f.height // (8 * vm)), -(-f.width // (8 * hm))
        order = [[(k, c, y * f.sampling[c][1] + v, x * f.sampling[c][0] + h) for k, c in enumerate(s.components) for v in range(f.sampling[c][1]) for h in range(f.sampling[c][0])] for y in range(units[0]) for x in range(units[1])]
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", s.data)]
    dc, ac = [_codes(d) for d, _ in s.tables], [_codes(a) for _, a in s.tables]
    step, one = s.restart or len(order), 1 << s.low
    for bits, start in zip(map(_Bits, parts), range(0, len(order), step), strict=False):
        previous, run = dict.fromkeys(s.components, 0), 0
        for unit in order[start : start + step]:
            for k, c, y, x in unit:
                block = planes[c][y, x]
                if s.first == 0:
                    if s.high:
                        block[0] |= bits.take(1) << s.low
                    else:
                        previous[c] += bits.signed(bits.symbol(dc[k]))
                        block[0] = previous[c] << s.low
                    continue
                at = s.first
                if not s.high:
                    if run:
                        run -= 1
                        continue
                    while at <= s.last:
                        r, size = divmod(bits.symbol(ac[k]), 16)
                        if size:
                            at += r
                            block[at] = bits.signed(size) << s.low
                            at += 1
                        elif r == 15:
                            at += 16
                        else:
                            run = (1 << r) - 1 + (bits.take(r) if r else 0)
                            break
                    continue

                def correct(i: int, block=block, bits=bits) -> None:
                    if bits.take(1) and not abs(int(block[i])) & one:
                        block[i] += one if block[i] > 0 else -one

                if not run:
                    while at <= s.last:
                        r, size = divmod(bits.symbol(ac[k]), 16)
                        new = 0
                        if size:
                            new = one if bits.take(1) else -one
                        elif r < 15:
                            run = (1 << r) + (bits.take(r) if r else 0)
                            break
                        while at <= s.last:
                            if block[at]:
                                correct(at)
                            elif r == 0:
                                if new:
                                    block[at] = new
                                at += 1
                                break
                            else:
                                r -= 1
                            at += 1
                if run:
                    for i in range(at, s.last + 1):
                        if block[i]:
                            correct(i)
                    run -= 1


def _lone(table: bytes | None) -> int | None:
    """The symbol of a table with one code, a single bit."""
    return table[16] if table and table[0] == 1 and len(table) == 17 else None


def _together(files: list[File]) -> np.ndarray | None:
    """Coefficients of files of one kind, [blocks, 64], component after component for each file, or
    None if their scans' bits aren't in places that the headers tell."""
    sizes = np.array([[int(np.prod(f.blocks(c))) for c in range(len(f.sampling))] for f in files])
    if any(f.blocks(c) != f.own_blocks(c) for f in files for c in range(len(f.sampling))):
        return None
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    rows = [np.concatenate([np.arange(e - n, e) for e, n in zip(ends[:, c], sizes[:, c], strict=True)]) for c in range(sizes.shape[1])]
    out = np.zeros((int(sizes.sum()), 64), np.int32)
    for k, s in enumerate(files[0].scans):
        if len(s.components) != 1:
            return None
        c = s.components[0]
        mine, n, band = rows[c], sizes[:, c], s.last - s.first + 1
        data = [f.scans[k].data for f in files]
        if not s.high:
            symbol = _lone(s.tables[0][0 if s.first == 0 else 1])
            if symbol != 7 or s.first == 0 and s.restart != 1 or s.first and s.restart:
                return None
            if s.first == 0:
                if any(len(d) != 3 * m - 2 for d, m in zip(data, n, strict=True)):
                    return None
                raw = np.frombuffer(b"".join(d + b"\xff\xd0" for d in data), np.uint8).reshape(-1, 3)
                if (raw[:, 1] != 0xFF).any():
                    return None
                raw = raw[:, :1]
            else:
                if any(len(d) != m * band for d, m in zip(data, n, strict=True)):
                    return None
                raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, band)
            if (raw & 0xC0 != 0x40).any():  # another code, or a negative number
                return None
            out[mine, s.first : s.last + 1] = raw.astype(np.int32) << s.low
            continue
        if s.restart:
            return None
        data = [d.replace(b"\xff\x00", b"\xff") for d in data]
        if s.first == 0:
            if any(len(d) != -(-m // 8) for d, m in zip(data, n, strict=True)):
                return None
            bits = np.unpackbits(np.frombuffer(b"".join(data), np.uint8))
            starts = 8 * np.concatenate([[0], np.cumsum(-(-n // 8))[:-1]])
            out[mine, 0] |= bits[np.concatenate([np.arange(a, a + m) for a, m in zip(starts, n, strict=True)])].astype(np.int32) << s.low
            continue
        if _lone(s.tables[0][1]) != 0 or (1 + band) % 8 or any(len(d) != m * (1 + band) // 8 for d, m in zip(data, n, strict=True)):
            return None
        bits = np.unpackbits(np.frombuffer(b"".join(data), np.uint8).reshape(-1, (1 + band) // 8), axis=1)
        held = out[mine, s.first : s.last + 1]
        if bits[:, 0].any() or (held <= 0).any():
            return None
        out[mine, s.first : s.last + 1] = held | bits[:, 1:].astype(np.int32) << s.low
    return out


def coefficients(files: list[File]) -> list[list[np.ndarray]]:
    """For each file and component an array [rows, columns, 64] in zigzag order, all scans added."""
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        kinds.setdefault((f.sampling, tuple(s.kind for s in f.scans)), []).append(i)
    out: list = [None] * len(files)
    for same in kinds.values():
        together = _together([files[i] for i in same])
        at = 0
        for i in same:
            f = files[i]
            shapes = [f.blocks(c) for c in range(len(f.sampling))]
            if together is None:
                out[i] = [np.zeros((*shape, 64), np.int32) for shape in shapes]
                for s in f.scans:
                    _general(f, s, out[i])
                continue
            out[i] = []
            for rows, columns in shapes:
                out[i].append(together[at : at + rows * columns].reshape(rows, columns, 64))
                at += rows * columns
    return out


def _pixels(plane: np.ndarray, quantiser: bytes) -> np.ndarray:
    """Inverse transform of [rows, columns, 64]: a plane of samples."""
    rows, columns, _ = plane.shape
    basis = _BASIS * np.frombuffer(quantiser, np.uint8).astype(np.float64)[:, None]
    flat = np.floor(plane.reshape(-1, 64).astype(np.float64) @ basis * 2.0**-14 + 128.5).clip(0, 255).astype(np.uint8)
    return flat.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)


def rgb_bands(f: File, planes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Full-resolution RGB, [height, width, 3], some rows of units at a time."""
    hm, vm = map(max, zip(*f.sampling, strict=True))
    units = planes[0].shape[0] // f.sampling[0][1]
    step = max(1, BAND // (64 * vm * max(1, planes[0].shape[1])))
    for y in range(0, units, step):
        full = []
        for c, (h, v) in enumerate(f.sampling):
            p = _pixels(planes[c][y * v : (y + step) * v], f.quantisers[c])
            full.append(p.repeat(vm // v, 0).repeat(hm // h, 1)[: f.height - 8 * vm * y, : f.width].astype(np.int32))
        if len(full) == 1:
            yield np.stack([full[0].astype(np.uint8)] * 3, axis=2)
            continue
        luma, blue, red = full[0], full[1] - 128, full[2] - 128
        out = np.empty((*luma.shape, 3), np.uint8)
        out[..., 0] = (luma + ((91881 * red + 32768) >> 16)).clip(0, 255)
        out[..., 1] = (luma - ((22554 * blue + 46802 * red + 32768) >> 16)).clip(0, 255)
        out[..., 2] = (luma + ((116130 * blue + 32768) >> 16)).clip(0, 255)
        yield out


def decode(media: list[bytes]) -> list[tuple[File, list[np.ndarray]]]:
    files = [parse(m) for m in media]
    return list(zip(files, coefficients(files), strict=True))


def payload(f: File, planes: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    flat = [p.reshape(-1) for p in planes]
    return (np.concatenate(flat) - 256).astype(np.uint8).tobytes()[: struct.unpack(">Q", f.comment)[0]]


def tensor(f: File, planes: list[np.ndarray]) -> bytes:
    """Full-resolution RGB as rows of uint8 triples."""
    return b"".join(band.tobytes() for band in rgb_bands(f, planes))


def feature(height: int, width: int, rgb) -> str:
    """Size, and the mean and mean square of each channel of an RGB tensor as whole numbers."""
    flat, total, squares = np.frombuffer(rgb, np.uint8).reshape(-1, 3), np.zeros(3, np.int64), np.zeros(3, np.int64)
    for at in range(0, len(flat), BAND):
        some = flat[at : at + BAND].astype(np.float64)
        total += some.sum(axis=0).astype(np.int64)  # whole numbers below 2^53
        squares += (some * some).sum(axis=0).astype(np.int64)
    n = len(flat)
    return f"{width}x{height} " + " ".join(f"{1000 * int(a) // n}/{1000 * int(b) // n}" for a, b in zip(total, squares, strict=True))


def padded(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), PAD)


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as a media column: doc_id, n_bytes, media."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some in shared.batches(batch, "text", BATCH):
                texts = [t.encode() for t in some.column(1).to_pylist()]
                media = encode([padded(t) for t in texts])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    shared.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), shared.empty_if_null().alias("text")).mapInArrow(shared.lean(run), "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """A column `media` of progressive JPEG files as RGB tensors: doc_id, height, width, rgb (rows of
    uint8 triples). A null file gives nulls."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for doc_id, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape, rgb = (None, None), None
                if m is not None:
                    ((f, planes),) = decode([m])
                    shape, rgb = (f.height, f.width), tensor(f, planes)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array(shape[:1], pa.int32()), pa.array(shape[1:], pa.int32()), pa.array([rgb], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(shared.lean(run), "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
TENSORS = DIGEST + ", height int, width int, rgb binary"


def images(docs: DataFrame) -> DataFrame:
    """Stores each text as a file, reads that back, and gives its digests and its RGB tensor (TENSORS)."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some in shared.batches(batch, "text", BATCH):
                texts = [t.encode() for t in some.column(1).to_pylist()]
                media = encode([padded(t) for t in texts])
                out = []
                for doc_id, text, m, (f, planes) in zip(some.column(0).to_pylist(), texts, media, decode(media), strict=True):
                    back = payload(f, planes)
                    out.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), f.height, f.width, tensor(f, planes)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TENSORS.split(", ")])

    shared.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), shared.empty_if_null().alias("text")).mapInArrow(shared.lean(run), TENSORS)


def described(made: DataFrame) -> DataFrame:
    """images(), or a stored table of them, with `feature`, computed from the tensors, in their place."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [feature(h, w, rgb.as_buffer()) for h, w, rgb in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb"), strict=True)]
            kept = [c for c in batch.schema.names if c not in ("height", "width", "rgb")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], names=[*kept, "feature"])

    shared.bound_batches(made.sparkSession)
    return made.mapInArrow(shared.lean(run), DIGEST + ", feature string")


def digests(docs: DataFrame) -> DataFrame:
    """Describes texts by their images and tensors. The tensors are a column on their way and in no table: they would take
    four times the room of the texts' table. A caller who wants them stored writes images()."""
    return described(images(docs))


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as progressive JPEG files, read back; their features come from the tensors."""
    return digests(shared.table(spark, sf_dir, "documents"))
