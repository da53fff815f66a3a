"""Directories of ZIP packages read by range: end record, ZIP64 records, central directory, place of stored members."""
from __future__ import annotations

import struct
from dataclasses import dataclass

# Signatures and sizes of the format's records.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED = 0


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


def read_at(f, at: int, size: int) -> bytes:
    f.seek(at)
    got = f.read(size)
    if len(got) < size:
        raise ValueError(f"the package ends before byte {at + size}")
    return got


def members(f, length: int) -> list[Member]:
    """All members of a package of `length` bytes; reads only its tail and its central directory."""
    tail_at = max(0, length - END_SIZE - FULL16 - LOCATOR64_SIZE)
    tail = read_at(f, tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_SIZE + int.from_bytes(tail[end + 20: end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)  # those bytes stood in the comment
    if end < 0:
        raise ValueError("no end record: not a ZIP package, or cut short")
    _, _, _, _, count, size, at, _ = struct.unpack("<4s4H2LH", tail[end: end + END_SIZE])
    if (count == FULL16 or FULL32 in (size, at)) and tail[end - LOCATOR64_SIZE: end].startswith(LOCATOR64):
        where = struct.unpack("<4sLQL", tail[end - LOCATOR64_SIZE: end])[2]
        record = read_at(f, where, 56)
        if not record.startswith(END64):
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, at = struct.unpack("<3Q", record[32:56])
    return _central(read_at(f, at, size), count)


def _central(data: bytes, count: int) -> list[Member]:
    out, p = [], 0
    for _ in range(count):
        head = data[p: p + CENTRAL_SIZE]
        if not head.startswith(CENTRAL):
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack("<2H", head[8:12])
        stored, size, name_len, extra_len, comment_len = struct.unpack("<2L3H", head[20:34])
        at = struct.unpack("<L", head[42:46])[0]
        name = data[p + CENTRAL_SIZE: p + CENTRAL_SIZE + name_len]
        extra = data[p + CENTRAL_SIZE + name_len: p + CENTRAL_SIZE + name_len + extra_len]
        size, stored, at = _wide(extra, size, stored, at)
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, stored, at))
        p += CENTRAL_SIZE + name_len + extra_len + comment_len
    return out


def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
    """Values with those that are full replaced, in order, from the ZIP64 extra field."""
    wide: list[int] = []
    while len(extra) >= 4:
        kind, size = struct.unpack("<2H", extra[:4])
        if kind == 1:
            wide = [x[0] for x in struct.iter_unpack("<Q", extra[4: 4 + size // 8 * 8])]
        extra = extra[4 + size:]
    it = iter(wide)
    return tuple(next(it, v) if v == FULL32 else v for v in values)


def data_at(f, member: Member) -> int:
    """First byte of a stored member's data."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed as a member and cannot be read by range")
    head = read_at(f, member.header_at, LOCAL_SIZE)
    if not head.startswith(LOCAL):
        raise ValueError(f"no local header of {member.name}")
    name_len, extra_len = struct.unpack("<2H", head[26:30])
    return member.header_at + LOCAL_SIZE + name_len + extra_len
