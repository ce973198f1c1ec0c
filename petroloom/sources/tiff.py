"""Tiled RGB TIFF files, as public specifications describe them (TIFF 6.0 and its 64-bit form)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

BIG = 1 << 31


@dataclass(frozen=True)
class Layout:
    """Where the parts of a file lie: a head, then the tiles without gaps, their index, the directory."""

    width: int
    height: int
    tile: int = 256
    compress: bool = True
    big: bool = False

    @property
    def count(self) -> int:
        return -(-self.width // self.tile) * -(-self.height // self.tile)

    @property
    def word(self) -> str:
        return "Q" if self.big else "I"

    @property
    def room(self) -> int:
        """Bytes of a place, and of a value in the directory."""
        return 8 if self.big else 4

    @property
    def first(self) -> int:
        """Where the tiles begin."""
        return 16 if self.big else 8

    def head(self, end: int) -> bytes:
        """The head of a file whose tiles end there."""
        start = self.spots(end)["directory"]
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if self.big else struct.pack("<2sHI", b"II", 42, start)

    def spots(self, end: int) -> dict[str, int]:
        """What lies behind tiles that end there, and where; values that fit into the directory lie there."""
        out = {}
        for name, length in (("bits", 6), ("at", self.count * self.room), ("sizes", self.count * self.room)):
            if length > self.room:
                out[name] = end + end % 2
                end = out[name] + length
        return out | {"directory": end + end % 2}

    def blank(self) -> bytes:
        """A black tile, which stands for all that are missing."""
        return packed(np.zeros((self.tile, self.tile, 3), np.uint8), self.compress)

    def closing(self, end: int, only: tuple[int, int]) -> list[tuple[int, bytes]]:
        """What is written when the tiles and their index are: (place, bytes). `only`: place and size of tile 0, which
        the directory of a file with one tile holds."""
        spots, bits = self.spots(end), struct.pack("<3H", 8, 8, 8)
        value = lambda name, inline: struct.pack(f"<{self.word}", spots[name]) if name in spots else inline.ljust(self.room, b"\0")
        at, sizes = (value(name, struct.pack(f"<{self.word}", x)) for name, x in zip(("at", "sizes"), only, strict=True))
        # fixed values: tags and kinds of the format
        entries = [(256, 4, 1, self.width), (257, 4, 1, self.height), (258, 3, 3, value("bits", bits)), (259, 3, 1, 8 if self.compress else 1), (262, 3, 1, 2), (277, 3, 1, 3), (284, 3, 1, 1), (322, 4, 1, self.tile), (323, 4, 1, self.tile), (324, 16 if self.big else 4, self.count, at), (325, 16 if self.big else 4, self.count, sizes)]
        body = struct.pack("<Q" if self.big else "<H", len(entries))
        for tag, kind, n, v in entries:
            v = v if isinstance(v, bytes) else struct.pack("<H" if kind == 3 else "<I", v).ljust(self.room, b"\0")
            body += struct.pack("<HH" + self.word, tag, kind, n) + v
        body += struct.pack(f"<{self.word}", 0)
        return [(0, self.head(end)), *([(spots["bits"], bits)] if "bits" in spots else []), (spots["directory"], body)]


def layout(width: int, height: int, tile: int = 256, compress: bool = True, big: bool | None = None) -> Layout:
    """`big` defaults to files whose pixels pass 2^31 bytes."""
    return Layout(width, height, tile, compress, width * height * 3 > BIG if big is None else big)


def write(out: BinaryIO, width: int, height: int, tiles: Iterable[tuple[int, bytes]], tile: int = 256, compress: bool = True, big: bool | None = None) -> None:
    """tiles: (number, row by row; compressed RGB of tile x tile pixels) in any order, streamed through.
    Missing tiles are black. For a mosaic whose tiles are a table, sources/mosaic_file.py writes in parallel."""
    made = layout(width, height, tile, compress, big)
    index, end = np.zeros((2, made.count), f"<u{made.room}"), made.first
    out.write(b"\0" * end)
    for number, data in tiles:
        index[:, number] = end, len(data)
        end += out.write(data)
    if not index[1].all():
        blank = made.blank()
        index[:, index[1] == 0] = [[end], [len(blank)]]
        end += out.write(blank)
    spots = made.spots(end)
    for name, row in zip(("at", "sizes"), index, strict=True):
        if name in spots:
            out.seek(spots[name])
            out.write(row.tobytes())
    for place, data in made.closing(end, (int(index[0, 0]), int(index[1, 0]))):
        out.seek(place)
        out.write(data)


def packed(rgb: np.ndarray, compress: bool = True) -> bytes:
    data = np.ascontiguousarray(rgb).tobytes()
    return zlib.compress(data, 6) if compress else data


def read(data: bytes) -> np.ndarray:
    """The pixels of a file that write() made."""
    big = data[2] == 43
    size, room = ("Q", 8) if big else ("I", 4)
    at = struct.unpack_from(f"<{size}", data, 8 if big else 4)[0]
    n = struct.unpack_from("<Q" if big else "<H", data, at)[0]
    at += 8 if big else 2
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from("<HH" + size, data, at + k * (20 if big else 12))
        code = {3: "H", 4: "I", 16: "Q"}[kind]
        where = at + k * (20 if big else 12) + 4 + room
        if struct.calcsize(f"<{count}{code}") > room:
            where = struct.unpack_from(f"<{size}", data, where)[0]
        tags[tag] = struct.unpack_from(f"<{count}{code}", data, where)
    (w,), (h,), (tile,) = tags[256], tags[257], tags[322]
    across = -(-w // tile)
    out = np.zeros((-(-h // tile) * tile, across * tile, 3), np.uint8)
    for k, (start, length) in enumerate(zip(tags[324], tags[325], strict=True)):
        body = data[start : start + length]
        body = zlib.decompress(body) if tags[259][0] == 8 else body
        y, x = k // across * tile, k % across * tile
        out[y : y + tile, x : x + tile] = np.frombuffer(body, np.uint8).reshape(tile, tile, 3)
    return out[:h, :w]
