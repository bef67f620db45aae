"""Exif: tags read from a TIFF directory, the rules of what a JPEG carries over, and writing them anew in big-endian order."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Sizes of the field types, and tags by their numbers.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
UNITS = {3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 5: 4, 10: 4, 12: 8}
KEPT = (270, 271, 272, 274, 282, 283, 296, 305, 306, 315, 33432)
LEFT_OUT = (37500, 40965)
EXIF_POINTER, GPS_POINTER = 34665, 34853
ORIENTATION, COLOUR_SPACE, WIDTH, HEIGHT = 274, 40961, 40962, 40963
MOST_ENTRIES, MOST_BYTES = 512, 65535


@dataclass(frozen=True)
class Tag:
    """A field; its value is in big-endian order."""

    tag: int
    type: int
    count: int
    value: bytes


def short(tag: int, v: int) -> Tag:
    return Tag(tag, 3, 1, struct.pack(">H", v))


def long(tag: int, v: int) -> Tag:
    return Tag(tag, 4, 1, struct.pack(">I", v))


#: Fields that strict readers expect: (directory, tag).
REQUIRED = (
    ("ifd0", Tag(282, 5, 1, struct.pack(">II", 72, 1))),
    ("ifd0", Tag(283, 5, 1, struct.pack(">II", 72, 1))),
    ("ifd0", short(296, 2)),
    ("ifd0", short(531, 1)),
    ("exif", Tag(36864, 7, 4, b"0232")),
    ("exif", Tag(37121, 7, 4, bytes((1, 2, 3, 0)))),
    ("exif", Tag(40960, 7, 4, b"0100")),
)


def big_endian(kind: int, value: bytes, little: bool) -> bytes:
    unit = UNITS.get(kind, 1)
    if not little or unit == 1:
        return value
    return b"".join(value[i : i + unit][::-1] for i in range(0, len(value), unit))


def directory(data: bytes, at: int, little: bool) -> list[tuple[int, int, int, bytes | None]]:
    """(tag, type, count, value in file order) of every entry; value is null for unknown types and places outside the file."""
    order = "<" if little else ">"
    if at + 2 > len(data):
        return []
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        return []
    out = []
    for i in range(n):
        e = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, e)
        size = SIZES.get(kind, 0) * count
        value = None
        if size and size <= 4:
            value = data[e + 8 : e + 8 + size]
        elif size:
            (place,) = struct.unpack_from(order + "I", data, e + 8)
            value = data[place : place + size] if place + size <= len(data) else None
        out.append((tag, kind, count, value))
    return out


def carried(data: bytes, at: int, little: bool, name: str) -> list[Tag]:
    """The fields of a directory that a JPEG may carry; a directory of over 512 entries gives none."""
    found = directory(data, at, little)
    if len(found) > MOST_ENTRIES:
        return []
    able = {"ifd0": lambda t: t in KEPT, "exif": lambda t: t not in LEFT_OUT, "gps": lambda t: True}[name]
    return [Tag(t, k, n, big_endian(k, v, little)) for t, k, n, v in found if v is not None and len(v) <= MOST_BYTES and able(t)]


def _set(tags: list[Tag], new: Tag) -> list[Tag]:
    return [new if t.tag == new.tag else t for t in tags] if any(t.tag == new.tag for t in tags) else [*tags, new]


def completed(dirs: dict[str, list[Tag]], width: int, height: int, srgb: bool) -> dict[str, list[Tag]]:
    """Directories with upright orientation, the image's size and space, and the required fields that are absent."""
    ifd0, sub, gps = (list(dirs.get(n, ())) for n in ("ifd0", "exif", "gps"))
    ifd0 = _set(ifd0, short(ORIENTATION, 1))
    if sub or width:
        for new in (long(WIDTH, width), long(HEIGHT, height), short(COLOUR_SPACE, 1 if srgb else 0xFFFF)):
            sub = _set(sub, new)
    out = {"ifd0": ifd0, "exif": sub, "gps": gps}
    for name, new in REQUIRED:
        if all(t.tag != new.tag for t in out[name]):
            out[name].append(new)
    return out


def _written(tags: list[Tag], at: int) -> bytes:
    """A directory sorted by tag with its long values behind it, each on an even place."""
    tags = sorted(tags, key=lambda t: t.tag)
    place = at + 2 + 12 * len(tags) + 4
    head, tail = struct.pack(">H", len(tags)), b""
    for t in tags:
        head += struct.pack(">HHI", t.tag, t.type, t.count)
        if len(t.value) <= 4:
            head += t.value.ljust(4, b"\x00")
        else:
            head += struct.pack(">I", place + len(tail))
            tail += t.value + bytes(len(t.value) % 2)
    return head + bytes(4) + tail


def block(dirs: dict[str, list[Tag]]) -> bytes:
    """The directories as one big-endian TIFF block; pointers are set to where they come to lie."""
    dirs = {n: list(t) for n, t in dirs.items() if t}
    pointers = {"exif": EXIF_POINTER, "gps": GPS_POINTER}
    ifd0 = dirs.get("ifd0", [])
    for n, tag in pointers.items():
        if n in dirs:
            ifd0 = _set(ifd0, long(tag, 0))
    at = 8 + len(_written(ifd0, 8))
    tail = b""
    for n, tag in pointers.items():
        if n in dirs:
            ifd0 = _set(ifd0, long(tag, at + len(tail)))
            tail += _written(dirs[n], at + len(tail))
    return b"MM" + struct.pack(">HI", 42, 8) + _written(ifd0, 8) + tail


def app_payload(dirs: dict[str, list[Tag]]) -> bytes:
    """Payload of the Exif segment, empty if it does not fit into one."""
    body = b"Exif\x00\x00" + block(dirs)
    return body if len(body) + 2 <= 65535 else b""
