"""ZIP packages of stored members: written as a stream, and read by their directories alone.

The writer makes ZIP64 packages without seeking back: sizes and checksums follow each member and stand
in the central directory.  The reader finds the end record behind the last comment, the ZIP64 end record
by its locator, allows for bytes in front of the package, and gives each member's place and length, so
that stored members are read by range, without extraction.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

LOCAL, CENTRAL, END, END64, AT64, AFTER = (b"PK" + x for x in (b"\3\4", b"\1\2", b"\5\6", b"\6\6", b"\6\7", b"\7\x08"))
MANY, LARGE = 0xFFFF, 0xFFFFFFFF
#: 1980-01-01: the same input makes the same bytes.
DAY = 0x21


class Package:
    """Writes members one after another; ``put`` takes bytes, ``written`` is how many were put so far."""

    def __init__(self, put: Callable[[bytes], None]):
        self.put, self.written, self.members = put, 0, []

    def _out(self, data: bytes) -> None:
        self.put(data)
        self.written += len(data)

    def begin(self, name: str) -> None:
        own = name.encode()
        self.members.append([own, self.written, 0, 0])
        self._out(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, DAY, 0, LARGE, LARGE, len(own), 20) + own + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Adds to the open member; the offset within it at which the data begin."""
        held = self.members[-1]
        at = held[3]
        held[2], held[3] = zlib.crc32(data, held[2]), at + len(data)
        self._out(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._out(struct.pack("<4sIQQ", AFTER, crc, size, size))

    def close(self) -> None:
        at = self.written
        for name, offset, crc, size in self.members:
            more = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._out(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, DAY, crc, LARGE, LARGE, len(name), len(more), 0, 0, 0, 0, LARGE) + name + more)
        size, n, end = self.written - at, len(self.members), self.written
        self._out(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, at))
        self._out(struct.pack("<4sIQI", AT64, 0, end, 1))
        self._out(struct.pack("<4sHHHHIIH", END, 0, 0, MANY, MANY, LARGE, LARGE, 0))


@dataclass
class Member:
    name: str
    stored: bool
    start: int  # of its bytes in the file
    size: int  # of its bytes in the file
    crc: int


def members(read: Callable[[int, int], bytes], length: int) -> Iterator[Member]:
    """The members of a package of ``length`` bytes that ``read(offset, size)`` reads; ValueError where it is none."""
    count, size, at, shift = _directory(read, length)
    held, p = read(at + shift, size), 0
    for _ in range(count):
        if held[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method, crc, packed, full, n, m, c, offset = struct.unpack("<8xHH4xIIIHHH8xI", held[p : p + 46])
        name, more = held[p + 46 : p + 46 + n], held[p + 46 + n : p + 46 + n + m]
        p += 46 + n + m + c
        full, packed, offset = _wide(more, full, packed, offset)
        if name.endswith(b"/"):
            continue
        head = read(offset + shift, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no member at {offset + shift}")
        start = offset + shift + 30 + sum(struct.unpack("<HH", head[26:30]))
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method == 0 and not flags & 1, start, packed, crc)


def _directory(read, length: int) -> tuple[int, int, int, int]:
    """Entries, size and stated offset of the central directory, and by how much the package is shifted in its file."""
    base = max(0, length - 22 - MANY - 20)
    tail = read(base, length - base)
    p = tail.rfind(END)
    while p >= 0 and (len(tail) < p + 22 or p + 22 + struct.unpack("<H", tail[p + 20 : p + 22])[0] != len(tail)):
        p = tail.rfind(END, 0, p)
    if p < 0:
        raise ValueError("not a ZIP package")
    count, size, at = struct.unpack("<10xHII", tail[p : p + 20])
    end = base + p
    if tail[max(0, p - 20) : p][:4] == AT64:
        stated = struct.unpack("<8xQ", tail[p - 20 : p - 4])[0]
        for at64 in (stated, base + p - 76):  # as stated; right before the locator, where bytes in front shift the package
            record = read(at64, 56) if 0 <= at64 < length else b""
            if record[:4] == END64:
                end, (count, size, at) = at64, struct.unpack("<32xQQQ", record)
                break
    if end == base + p and (count == MANY or LARGE in (size, at)):
        raise ValueError("no ZIP64 end record")
    return count, size, at, end - size - at


def _wide(more: bytes, full: int, packed: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset, from the ZIP64 field where they do not fit."""
    p, out = 0, [full, packed, offset]
    while p + 4 <= len(more):
        kind, n = struct.unpack("<HH", more[p : p + 4])
        if kind == 1:
            q = p + 4
            for i, x in enumerate(out):
                if x == LARGE and q + 8 <= p + 4 + n:
                    out[i] = struct.unpack("<Q", more[q : q + 8])[0]
                    q += 8
        p += 4 + n
    return tuple(out)
