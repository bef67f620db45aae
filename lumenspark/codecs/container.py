"""Multi-picture JPEG files: segment walk, image split, index, gain map payload, and surgery on segments.

Layouts follow ITU-T T.81 (markers), CIPA DC-007 (multi-picture index) and the gain map standard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Identifiers, type codes and sizes of the formats.
URN = b"urn:iso:std:iso:ts:21496:-1\x00"
XMP_ID = b"http://ns.adobe.com/xap/1.0/\x00"
ICC_ID = b"ICC_PROFILE\x00"
MPF_ID = b"MPF\x00"
SOI, EOI = b"\xff\xd8", b"\xff\xd9"
TYPE_PRIMARY, TYPE_GAIN, REPRESENTATIVE = 0x030000, 0x050000, 1 << 29
DENOMINATOR = 1_000_000
ICC_CHUNK = 65519
ENTRY = 16


class FormatError(ValueError):
    """A file that breaks its format."""


@dataclass(frozen=True)
class Segment:
    marker: int
    offset: int  # of the marker
    payload: int  # of what follows the length
    size: int  # of the payload

    @property
    def end(self) -> int:
        return self.payload + self.size


def _alone(marker: int) -> bool:
    return marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7


def walk(data: bytes, start: int = 0) -> tuple[list[Segment], int]:
    """Segments of the image at start up to its scan, and where the image ends."""
    out, at = [], start + 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if _alone(marker):
            at += 2
        elif marker == 0xD9:
            return out, at + 2
        elif marker == 0xDA:
            stop = data.find(EOI, at)
            return out, len(data) if stop < 0 else stop + 2
        else:
            (length,) = struct.unpack_from(">H", data, at + 2)
            out.append(Segment(marker, at, at + 4, length - 2))
            at += 2 + length
    return out, len(data)


def starts(data: bytes) -> list[int]:
    """Where images begin: at 0, and at each start marker right behind an end marker."""
    out, at = [], data.find(SOI)
    while at >= 0:
        if at == 0 or data[at - 2 : at] == EOI:
            out.append(at)
        at = data.find(SOI, at + 2)
    return out


def split(data: bytes) -> list[bytes]:
    at = starts(data)
    return [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]


def find(data: bytes, segments: list[Segment], marker: int, prefix: bytes) -> Segment | None:
    """First segment with a marker whose payload begins with a prefix."""
    return next((s for s in segments if s.marker == marker and data[s.payload : s.end].startswith(prefix)), None)


def segment(marker: int, payload: bytes) -> bytes:
    if len(payload) + 2 > 65535:
        raise FormatError(f"a segment holds at most 65533 bytes, not {len(payload)}")
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


def jfif(multi_picture: bool = False) -> bytes:
    return segment(0xE0, b"JFIF\x00" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0) + (b"AMPF" if multi_picture else b""))


def xmp(packet: str) -> bytes:
    return segment(0xE1, XMP_ID + packet.encode())


def icc(profile: bytes) -> list[bytes]:
    """The profile in numbered chunks."""
    n = -(-len(profile) // ICC_CHUNK)
    if n > 255:
        raise FormatError("the colour profile is too large to embed")
    return [segment(0xE2, ICC_ID + bytes((i + 1, n)) + profile[i * ICC_CHUNK : (i + 1) * ICC_CHUNK]) for i in range(n)]


# the gain map payload ---------------------------------------------------------------------------
@dataclass(frozen=True)
class GainMeta:
    """What a file says about its gain map; the five parameters have one value for each of three channels."""

    multi: bool = True
    use_base: bool = True
    apple: bool = False
    base_headroom: float = 0.0
    alt_headroom: float = 0.0
    lo: tuple = (0.0, 0.0, 0.0)
    hi: tuple = (1.0, 1.0, 1.0)
    gamma: tuple = (1.0, 1.0, 1.0)
    base_offset: tuple = (1 / 64,) * 3
    alt_offset: tuple = (1 / 64,) * 3

    def channels(self) -> list[tuple]:
        rows = list(zip(self.lo, self.hi, self.gamma, self.base_offset, self.alt_offset, strict=True))
        return rows if self.multi else rows[:1]


def _half_up(v: float) -> int:
    return int(v + 0.5) if v >= 0 else -int(0.5 - v)


def _rational(v: float, signed: bool) -> bytes:
    low, high = (-(1 << 31), (1 << 31) - 1) if signed else (0, (1 << 32) - 1)
    return struct.pack(">iI" if signed else ">II", _half_up(min(max(v * DENOMINATOR, low), high)), DENOMINATOR)


def payload(m: GainMeta) -> bytes:
    """89 bytes with one channel, 169 with three."""
    body = URN + struct.pack(">HHB", 0, 1, (0x80 if m.multi else 0) | (0x40 if m.use_base else 0))
    body += _rational(m.base_headroom, False) + _rational(m.alt_headroom, False)
    for row in m.channels():
        body += b"".join(_rational(v, k != 2) for k, v in enumerate(row))
    return body


def base_marker() -> bytes:
    """The segment by which a base image says that a gain map belongs to it."""
    return segment(0xE2, URN + bytes(4))


def parse_payload(body: bytes) -> dict:
    """Fields of a payload that begins with the identifier; a rational over 0 reads as 0."""
    at = len(URN)
    flags = body[at + 4]
    multi = bool(flags & 0x80)

    def value(k: int) -> float:
        n, d = struct.unpack_from(">iI", body, at + 5 + 8 * k)
        return n / d if d else 0.0

    rows = [[value(2 + 5 * c + k) for k in range(5)] for c in range(3 if multi else 1)]
    return {"multi": multi, "use_base": bool(flags & 0x40), "writer_version": struct.unpack_from(">H", body, at + 2)[0], "alt_headroom": value(1), "channels": rows}


# the multi-picture index ------------------------------------------------------------------------
def index_body(types: list[int], sizes: list[int], offsets: list[int]) -> bytes:
    """Index of as many images as there are types: a directory of three tags, then an entry each."""
    n = len(types)
    tags = ((0xB000, 7, 4, b"0100"), (0xB001, 4, 1, struct.pack(">I", n)), (0xB002, 7, ENTRY * n, struct.pack(">I", 8 + 2 + 3 * 12 + 4)))
    body = MPF_ID + b"MM" + struct.pack(">HIH", 42, 8, len(tags))
    body += b"".join(struct.pack(">HHI", t, kind, count) + value for t, kind, count, value in tags) + bytes(4)
    return body + b"".join(struct.pack(">IIIHH", t, s, o, 0, 0) for t, s, o in zip(types, sizes, offsets, strict=True))


def types_of(n: int) -> list[int]:
    return [REPRESENTATIVE | TYPE_PRIMARY] + [TYPE_GAIN] * (n - 1)


def index_placeholder(n: int = 2) -> bytes:
    return segment(0xE2, index_body(types_of(n), [0] * n, [0] * n))


def parse_index(data: bytes) -> dict | None:
    """Base (the byte-order field) and entries (attributes, size, offset) of the first index in the data, of either byte order."""
    at = data.find(MPF_ID)
    if at < 0 or at + 12 > len(data):
        return None
    base = at + 4
    order = ">" if data[base : base + 2] == b"MM" else "<"
    try:
        directory = base + struct.unpack_from(order + "I", data, base + 4)[0]
        (tags,) = struct.unpack_from(order + "H", data, directory)
        count, entries = 0, None
        for i in range(tags):
            tag, _, _, value = struct.unpack_from(order + "HHII", data, directory + 2 + 12 * i)
            if tag == 0xB001:
                count = value
            elif tag == 0xB002:
                entries = base + value
        if entries is None:
            return None
        return {"base": base, "at": entries, "order": order, "entries": [struct.unpack_from(order + "III", data, entries + ENTRY * i) for i in range(count)]}
    except struct.error:
        return None


def _index_segment(data: bytes, limit: int | None = None) -> Segment:
    segments, _ = walk(data[:limit] if limit else data)
    found = find(data, segments, 0xE2, MPF_ID)
    if found is None:
        raise FormatError("the primary image has no multi-picture index")
    return found


def patch_index(data: bytes, sizes: list[int]) -> bytes:
    """Sizes and offsets of all images written into the primary's index; offsets count from the byte-order field."""
    own = _index_segment(data, sizes[0])
    base, at = own.payload + 4, own.payload + 4 + 8 + 2 + 3 * 12 + 4
    if at + ENTRY * len(sizes) > len(data):
        raise FormatError("truncated multi-picture index")
    out, place = bytearray(data), 0
    for i, size in enumerate(sizes):
        struct.pack_into(">II", out, at + ENTRY * i + 4, size, place - base if i else 0)
        place += size
    return bytes(out)


def recompute_index(data: bytes) -> bytes:
    """The index made to fit the images that are in the file."""
    found = parse_index(data)
    if found is None:
        raise FormatError("no multi-picture index")
    at = starts(data)
    out = bytearray(data)
    for i, (a, b) in enumerate(list(zip(at, [*at[1:], len(data)], strict=True))[: len(found["entries"])]):
        struct.pack_into(found["order"] + "II", out, found["at"] + ENTRY * i + 4, b - a, a - found["base"] if i else 0)
    return bytes(out)


def retype_index(data: bytes) -> bytes:
    """The index's first image typed as primary, up to two more as gain maps; without an index nothing changes."""
    found = parse_index(data)
    out = bytearray(data)
    for i, kind in enumerate(types_of(min(3, len(found["entries"]))) if found else ()):
        struct.pack_into(found["order"] + "I", out, found["at"] + ENTRY * i, kind)
    return bytes(out)


# surgery ----------------------------------------------------------------------------------------
def concat(primary: bytes, *others: bytes) -> bytes:
    """One file of several images with its index patched."""
    return patch_index(primary + b"".join(others), [len(primary), *map(len, others)])


def insert_after(data: bytes, anchors: list[tuple[int, bytes]], made: bytes) -> bytes:
    """A segment put behind the first anchor (marker, prefix) that is there."""
    segments, _ = walk(data)
    for marker, prefix in anchors:
        if (found := find(data, segments, marker, prefix)) is not None:
            return data[: found.end] + made + data[found.end :]
    raise FormatError("no anchor segment")


def drop_segment(data: bytes, marker: int, prefix: bytes) -> bytes:
    segments, _ = walk(data)
    found = find(data, segments, marker, prefix)
    if found is None:
        raise FormatError("no such segment")
    return data[: found.offset] + data[found.end :]


def replace_xmp(data: bytes, packet: str) -> bytes:
    """The first XMP packet of an image replaced, or one put behind the start marker."""
    segments, _ = walk(data)
    found = find(data, segments, 0xE1, XMP_ID)
    if found is None:
        return data[:2] + xmp(packet) + data[2:]
    return data[: found.offset] + xmp(packet) + data[found.end :]


def splice(primary_of: bytes, trailer_of: bytes) -> bytes:
    """Primary of one file and trailer of another; the directory's length is rewritten in as many bytes."""
    import re

    primary, rest = split(primary_of)[0], split(trailer_of)[1:]
    if not rest:
        raise FormatError("no trailer image")
    trailer = b"".join(rest)
    m = re.search(rb'Item:Length="(\d+)"', primary)
    if m:
        new = str(len(trailer)).encode()
        if len(new) > len(m[1]):
            raise FormatError("the new length needs more digits than the old one")
        primary = primary[: m.start(1)] + new + b'"' + b" " * (len(m[1]) - len(new)) + primary[m.end(1) + 1 :]
    return primary + trailer


def with_index_of(primary: bytes, others: list[bytes]) -> bytes:
    """The primary's index rebuilt for all images (its length depends on their number), then one file of them all."""
    own = _index_segment(primary)
    rebuilt = primary[: own.offset] + index_placeholder(1 + len(others)) + primary[own.end :]
    return concat(rebuilt, *others)


@dataclass
class Rules:
    """Conformance results of one file: (rule, required, passed, detail)."""

    rows: list[tuple[str, bool, bool, str]] = field(default_factory=list)

    def check(self, rule: str, passed: bool, detail: str = "", required: bool = True) -> bool:
        self.rows.append((rule, required, bool(passed), detail))
        return bool(passed)

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.rows)
