"""Reading ZIP-packaged web archives by ranges: end records, ZIP64, central directory, stored members."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Fixed values of the ZIP format (APPNOTE 6.3): signatures of its records, and the id of the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ZIP64_EXTRA = 1
STORED = 0


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed_size: int
    header_at: int


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"{n} bytes wanted at {at}, {len(got)} there")
    return got


def members(f, size: int) -> list[Member]:
    """Members by the central directory.  ``f`` is any seekable file, ``size`` its length; the members' bytes aren't read."""
    tail_at = max(0, size - 65557)  # end record and the longest comment
    tail = read_at(f, tail_at, size - tail_at)
    i = len(tail)
    while (i := tail.rfind(END, 0, i)) >= 0:
        if i + 22 <= len(tail) and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] == len(tail):
            break
    if i < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, i + 10)
    end_at = tail_at + i
    if end_at >= 20 and (locator := read_at(f, end_at - 20, 20))[:4] == LOCATOR64:
        record = read_at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points elsewhere")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = read_at(f, start, length), [], 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == ZIP64_EXTRA:  # holds only those values that don't fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        found.append(Member(name, method, full, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_at(f, m: Member) -> int:
    """Where a stored member's bytes begin; its local header's name and extra field may differ from the directory's."""
    if m.method != STORED:
        raise ValueError(f"{m.name} isn't stored")
    local = read_at(f, m.header_at, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {m.name}")
    return m.header_at + 30 + sum(struct.unpack_from("<HH", local, 26))
