"""Classic TIFF by the TIFF 6.0 specification: directory, acceptance, segments and their decoding; and a writer for fixtures."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from .exif import SIZES, directory

# Tags by their numbers.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, SAMPLES = 256, 257, 258, 259, 262, 273, 274, 277
ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 278, 279, 284, 317, 322, 323, 324, 325, 339
XMP, EXIF, ICC, GPS = 700, 34665, 34675, 34853
NONE, LZW, PACKBITS = 1, 5, 32773


class TiffError(ValueError):
    """A file that is no TIFF, or one of a kind that is not accepted."""


@dataclass
class Header:
    """What the first directory says about an image."""

    little: bool
    ifd0: int
    width: int = 0
    height: int = 0
    bits: int = 1
    samples: int = 0
    format: int = 1
    compression: int = NONE
    photometric: int = 1
    planar: int = 1
    predictor: int = 1
    rows_per_strip: int = 0
    tile_width: int = 0
    tile_height: int = 0
    tiled: bool = False
    orientation: int = 1
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    icc: bytes | None = None
    xmp: bytes | None = None
    exif: int | None = None
    gps: int | None = None

    @property
    def channels(self) -> int:
        return 3 if self.photometric == 2 else 1

    @property
    def is_float(self) -> bool:
        return self.format == 3

    def geometry(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """(index, plane, y0, x0, rows, columns, samples) of every segment that holds colour."""
        planes, inside = (self.channels, 1) if self.planar == 2 else (1, self.samples)
        out = []
        if self.tiled:
            across, down = -(-self.width // self.tile_width), -(-self.height // self.tile_height)
            for p in range(planes):
                for i in range(across * down):
                    out.append((p * across * down + i, p, i // across * self.tile_height, i % across * self.tile_width, self.tile_height, self.tile_width, inside))
            return out
        down = -(-self.height // self.rows_per_strip)
        for p in range(planes):
            for i in range(down):
                y = i * self.rows_per_strip
                out.append((p * down + i, p, y, 0, min(self.rows_per_strip, self.height - y), self.width, inside))
        return out


def byte_order(data: bytes) -> bool:
    """Whether a file is little-endian."""
    if len(data) < 8:
        raise TiffError("not a TIFF file: too small")
    if data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file: bad byte order mark")
    little = data[:2] == b"II"
    (magic,) = struct.unpack_from("<H" if little else ">H", data, 2)
    if magic == 43:
        raise TiffError("BigTIFF is not supported")
    if magic != 42:
        raise TiffError("not a TIFF file: bad magic")
    return little


def numbers(kind: int, value: bytes, little: bool) -> list[int]:
    width = 1 if SIZES[kind] == 1 else 2 if kind in (3, 8) else 4
    order = "<" if little else ">"
    step = SIZES[kind]
    return [struct.unpack_from(order + {1: "B", 2: "H", 4: "I"}[width], value, i)[0] for i in range(0, len(value), step)]


def header(data: bytes) -> Header:
    """The header of a file; TiffError with the reason if it is not accepted."""
    little = byte_order(data)
    (at,) = struct.unpack_from("<I" if little else ">I", data, 4)
    entries = directory(data, at, little)
    if not entries:
        raise TiffError("truncated TIFF: first directory")
    h, bits, strips, counts = Header(little, at), [], False, None
    known = {WIDTH: "width", LENGTH: "height", COMPRESSION: "compression", PHOTOMETRIC: "photometric", ORIENTATION: "orientation", SAMPLES: "samples", ROWS_PER_STRIP: "rows_per_strip", PLANAR: "planar", PREDICTOR: "predictor", FORMAT: "format", TILE_WIDTH: "tile_width", TILE_LENGTH: "tile_height", EXIF: "exif", GPS: "gps"}
    wanted = {*known, BITS, STRIPS, STRIP_BYTES, TILES, TILE_BYTES, ICC, XMP}
    for tag, kind, _, value in entries:
        if tag not in wanted:
            continue
        if kind not in SIZES:
            raise TiffError("unsupported TIFF field type")
        if value is None:
            raise TiffError("truncated TIFF: field value")
        if tag in (ICC, XMP):
            setattr(h, "icc" if tag == ICC else "xmp", value)
            continue
        found = numbers(kind, value, little)
        if not found:
            raise TiffError("TIFF field has fewer values than expected")
        if tag in known:
            setattr(h, known[tag], found[0])
        elif tag == BITS:
            bits = found
        elif tag in (STRIPS, TILES):
            h.offsets, h.tiled, strips = found, h.tiled or tag == TILES, strips or tag == STRIPS
        else:
            counts = found
    h.sizes = counts or []
    h.samples = h.samples or len(bits) or 1
    bits = bits or [1] * h.samples
    h.bits = bits[0]
    if (reason := rejection(h, bits, strips)) is not None:
        raise TiffError(reason)
    h.rows_per_strip = h.rows_per_strip or h.height
    return h


def rejection(h: Header, bits: list[int], strips: bool) -> str | None:
    """Why an image is not accepted, or null."""
    rules = (
        (h.width == 0 or h.height == 0, "no image dimensions"),
        (len(set(bits)) > 1, "mixed sample widths"),
        (h.bits not in (8, 16, 32), f"unsupported bit depth {h.bits}"),
        (h.format == 3 and h.bits != 32, "floating point needs 32 bits"),
        (h.format not in (1, 3), f"unsupported sample format {h.format}"),
        (h.bits == 32 and h.format != 3, "32-bit integers are not supported"),
        (h.photometric not in (0, 1, 2), f"unsupported photometric interpretation {h.photometric}"),
        (h.photometric == 2 and h.samples < 3, "RGB with fewer than 3 samples"),
        (h.compression in (8, 32946), "deflate compression is not supported"),
        (h.compression == 7, "JPEG compression is not supported"),
        (h.compression not in (NONE, LZW, PACKBITS, 7, 8, 32946), f"unsupported compression {h.compression}"),
        (h.predictor not in (1, 2, 3), f"unsupported predictor {h.predictor}"),
        (h.planar not in (1, 2), "unsupported planar configuration"),
        (not h.tiled and not strips, "neither strip nor tile offsets"),
        (h.tiled and not (h.tile_width and h.tile_height), "tile dimensions missing"),
        (len(h.sizes) != len(h.offsets), "offsets and byte counts disagree"),
    )
    return next((reason for bad, reason in rules if bad), None)


# segments ---------------------------------------------------------------------------------------
def unpack_lzw(data: bytes, expected: int) -> bytes:
    """LZW with the most significant bit first and code widths that grow one code early."""
    out = bytearray()
    table: list[bytes] = []
    width, before, held, n = 9, b"", 0, 0
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(singles), 9, b""
            continue
        if not before:
            if code > 255:
                raise TiffError("corrupt LZW stream: bad first code")
            table = table or list(singles)
            before = singles[code]
            out += before
            continue
        if code < len(table):
            text = table[code]
        elif code == len(table) or len(table) >= 4096:
            text = before + before[:1]
        else:
            raise TiffError("corrupt LZW stream")
        out += text
        if len(table) < 4096:
            table.append(before + text[:1])
        before = text
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) > expected + 4096:
            break
    return bytes(out[:expected]).ljust(expected, b"\x00")


def unpack_packbits(data: bytes, expected: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < expected:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < len(data):
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:expected]).ljust(expected, b"\x00")


def unpacked(compression: int, data: bytes, expected: int) -> bytes:
    """Bytes of a segment; what is missing is zero."""
    if compression == NONE:
        return data[:expected].ljust(expected, b"\x00")
    return {LZW: unpack_lzw, PACKBITS: unpack_packbits}[compression](data, expected)


def samples_of(raw: bytes, rows: int, columns: int, samples: int, bits: int, little: bool, predictor: int) -> np.ndarray:
    """Samples [row, column, sample] in native order with the predictor undone."""
    size = bits // 8
    kind = ("<" if little else ">") + ("f4" if bits == 32 else f"u{size}")
    if predictor == 3:
        b = np.frombuffer(raw, np.uint8).reshape(rows, columns * samples * size)
        b = np.cumsum(b, axis=1, dtype=np.uint64).astype(np.uint8)
        planes = b.reshape(rows, size, columns * samples).transpose(0, 2, 1)
        made = ">f4" if bits == 32 else f">u{size}"
        return np.ascontiguousarray(planes).view(made).reshape(rows, columns, samples)
    v = np.frombuffer(raw, kind).reshape(rows, columns, samples)
    if predictor == 2:
        if bits == 32:
            raise TiffError("the horizontal predictor is not defined for 32-bit samples")
        v = np.cumsum(v, axis=1, dtype=np.uint64).astype(f"u{size}")
    return v


def band(raw: bytes, h: dict, rows: int, columns: int, samples: int, y0: int, x0: int) -> np.ndarray:
    """Light values [row, column, channel] of a segment, cut to the image: integers scaled to 0..1, reversed where 0 is white.

    h: little, bits, compression, predictor, photometric, width, height, channels (as many as the segment has).
    """
    size = rows * columns * samples * (h["bits"] // 8)
    v = samples_of(unpacked(h["compression"], raw, size), rows, columns, samples, h["bits"], h["little"], h["predictor"])
    v = v[: h["height"] - y0, : h["width"] - x0, : h["channels"]].astype(np.float32)
    if h["bits"] < 32:
        v = v * np.float32(1 / (255 if h["bits"] == 8 else 65535))
    return np.float32(1) - v if h["photometric"] == 0 else v


def decode(data: bytes) -> tuple[Header, np.ndarray]:
    """Header and whole raster [y, x, channel]; for single files, tests and small images."""
    h = header(data)
    out = np.zeros((h.height, h.width, h.channels), np.float32)
    for index, plane, y0, x0, rows, columns, samples in h.geometry():
        if index >= len(h.offsets) or h.offsets[index] + h.sizes[index] > len(data):
            raise TiffError("truncated TIFF: pixel data")
        own = {**vars(h), "channels": 1 if h.planar == 2 else h.channels}
        v = band(data[h.offsets[index] : h.offsets[index] + h.sizes[index]], own, rows, columns, samples, y0, x0)
        at = slice(plane, plane + 1) if h.planar == 2 else slice(None)
        out[y0 : y0 + v.shape[0], x0 : x0 + v.shape[1], at] = v
    return h, out


# writing ----------------------------------------------------------------------------------------
def pack_lzw(data: bytes) -> bytes:
    out, n, held = bytearray(), 0, 0
    table = {bytes((i,)): i for i in range(256)}
    width, size, text = 9, 258, b""

    def put(code: int) -> None:
        nonlocal n, held
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
        held &= (1 << n) - 1

    put(256)
    for i in range(len(data)):
        more = text + data[i : i + 1]
        if more in table:
            text = more
            continue
        put(table[text])
        table[more] = size
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
        text = data[i : i + 1]
    if text:
        put(table[text])
        if size + 1 + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(held << 8 - n & 255)
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    """Runs of three and more, and literals between them."""
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at
        while end < len(data) and end - at < 128 and not (data[end : end + 3] == data[end : end + 1] * 3):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def write(
    v: np.ndarray, bits: int = 16, little: bool = True, rows_per_strip: int = 0, tile: int = 0, planar: int = 1, compression: int = NONE, predictor: int = 1, photometric: int | None = None, alpha: bool = False, more: tuple = (), exif: list | None = None, gps: list | None = None
) -> bytes:
    """A TIFF of light values [y, x, channel]: strips or square tiles, chunky or planar, in any accepted packing.

    more: (tag, type, count, value in file order); exif and gps: such fields of the directories behind.
    """
    height, width, channels = v.shape
    order = "<" if little else ">"
    if photometric == 0:
        v = 1 - v
    if alpha:
        v = np.concatenate([v, np.ones((height, width, 1), v.dtype)], 2)
    made = v.astype(order + "f4") if bits == 32 else np.floor(np.clip(v, 0, 1) * ((1 << bits) - 1) + 0.5).astype(f"{order}u{bits // 8}")
    planes = [made[:, :, i : i + 1] for i in range(made.shape[2])] if planar == 2 else [made]

    def packed(b: np.ndarray) -> bytes:
        rows, columns, samples = b.shape
        if predictor == 2:
            d = b.astype(np.int64)
            d[:, 1:] -= b.astype(np.int64)[:, :-1]
            raw = (d % (1 << bits)).astype(b.dtype).tobytes()
        elif predictor == 3:
            p = b.astype(b.dtype.newbyteorder(">")).reshape(rows, columns * samples, 1).view(np.uint8).transpose(0, 2, 1).reshape(rows, -1).astype(np.int64)
            p[:, 1:] -= p[:, :-1].copy()
            raw = (p % 256).astype(np.uint8).tobytes()
        else:
            raw = np.ascontiguousarray(b).tobytes()
        return {NONE: lambda x: x, LZW: pack_lzw, PACKBITS: pack_packbits}[compression](raw)

    pieces = []
    for p in planes:
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    b = np.zeros((tile, tile, p.shape[2]), p.dtype)
                    cut = p[y : y + tile, x : x + tile]
                    b[: cut.shape[0], : cut.shape[1]] = cut
                    pieces.append(packed(b))
        else:
            step = rows_per_strip or height
            pieces += [packed(p[y : y + step]) for y in range(0, height, step)]
    short = lambda *x: (3, len(x), struct.pack(f"{order}{len(x)}H", *x))
    long_ = lambda *x: (4, len(x), struct.pack(f"{order}{len(x)}I", *x))
    n = made.shape[2]
    tags = {WIDTH: long_(width), LENGTH: long_(height), BITS: short(*[bits] * n), COMPRESSION: short(compression), PHOTOMETRIC: short((2 if channels == 3 else 1) if photometric is None else photometric), SAMPLES: short(n), PLANAR: short(planar), PREDICTOR: short(predictor), FORMAT: short(*[3 if bits == 32 else 1] * n)}
    tags |= {TILE_WIDTH: short(tile), TILE_LENGTH: short(tile)} if tile else {ROWS_PER_STRIP: long_(rows_per_strip or height)}
    tags |= {t: (k, c, x) for t, k, c, x in more}
    names = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
    tags |= {names[0]: long_(*[0] * len(pieces)), names[1]: long_(*map(len, pieces))}
    tags |= {t: long_(0) for t, d in ((EXIF, exif), (GPS, gps)) if d is not None}

    def laid(entries: dict, at: int) -> bytes:
        place, head, tail = at + 2 + 12 * len(entries) + 4, struct.pack(order + "H", len(entries)), b""
        for t, (k, c, x) in sorted(entries.items()):
            head += struct.pack(order + "HHI", t, k, c)
            if len(x) <= 4:
                head += x.ljust(4, b"\x00")
            else:
                head += struct.pack(order + "I", place + len(tail))
                tail += x + bytes(len(x) % 2)
        return head + bytes(4) + tail

    at = 8 + len(laid(tags, 8))
    below = b""
    for t, d in ((EXIF, exif), (GPS, gps)):
        if d is not None:
            tags[t] = long_(at + len(below))
            below += laid({x[0]: x[1:] for x in d}, at + len(below))
    starts, place = [], at + len(below)
    for p in pieces:
        starts.append(place)
        place += len(p)
    tags[names[0]] = long_(*starts)
    return (b"II" if little else b"MM") + struct.pack(order + "HI", 42, 8) + laid(tags, 8) + below + b"".join(pieces)
