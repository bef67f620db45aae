"""Baseline sequential JPEG by ITU-T T.81 in numpy: encoder with optimal or standard Huffman tables, and a decoder."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from . import container

# Quantisation tables, Huffman tables and the zigzag order of ITU-T T.81, annexes F and K.
LUMA = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
CHROMA = np.array(
    [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
     99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99]
)
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)
AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    list(bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )),
)


def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients along the anti-diagonals, which are run through in turns."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
#: Rows of the orthonormal DCT.
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Blocks whose bits are laid out at once.
PART = 8192


def scaled(table: np.ndarray, quality: int) -> np.ndarray:
    """A quantisation table for a quality of 1 to 100."""
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((table * scale + 50) // 100, 1, 255)


# Huffman tables ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Table:
    """Codes per length (1 to 16) and symbols in code order; code and length by symbol."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]
    code: np.ndarray
    length: np.ndarray


def table(counts, symbols) -> Table:
    code, length, at, k = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            code[symbols[k]], length[symbols[k]] = at, bits
            at, k = at + 1, k + 1
        at <<= 1
    return Table(tuple(counts), tuple(symbols), code, length)


def code_lengths(frequency: np.ndarray) -> np.ndarray:
    """Lengths of an optimal code over the symbols that occur and one reserved symbol (256), which keeps the code of ones free.

    Of equally rare nodes the one with the larger number is merged first.
    """
    weight = {i: int(f) for i, f in enumerate(frequency) if f}
    weight[256] = 1
    members = {i: [i] for i in weight}
    length = np.zeros(257, np.int64)
    while len(weight) > 1:
        a = min(weight, key=lambda i: (weight[i], -i))
        rest = weight.pop(a)
        b = min(weight, key=lambda i: (weight[i], -i))
        # the merged node keeps the number of the rarest
        weight[a] = weight.pop(b) + rest
        members[a] = members.pop(a) + members.pop(b)
        length[members[a]] += 1
    return length


def limited(lengths: np.ndarray, most: int = 16) -> list[int]:
    """Codes per length 1..most with longer ones moved up as in annex K.3, the reserved symbol's code taken out."""
    counts = np.bincount(lengths[lengths > 0], minlength=most + 2).tolist()
    for i in range(len(counts) - 1, most, -1):
        while counts[i]:
            j = i - 2
            while not counts[j]:
                j -= 1
            for at, change in ((i, -2), (i - 1, 1), (j + 1, 2), (j, -1)):
                counts[at] += change
    last = max(i for i in range(most + 1) if counts[i])
    counts[last] -= 1
    return counts[1 : most + 1]


def optimal(frequency: np.ndarray) -> Table:
    """The best table of codes of up to 16 bits for symbol counts."""
    if not frequency.any():
        frequency = np.bincount([0], minlength=256)
    lengths = code_lengths(frequency)
    order = sorted((i for i in range(256) if lengths[i]), key=lambda i: (lengths[i], i))
    return table(limited(lengths), order)


# colour and blocks ------------------------------------------------------------------------------
def _fixed(rgb: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    v = rgb.astype(np.int64)
    return np.clip((v[..., 0] * row[0] + v[..., 1] * row[1] + v[..., 2] * row[2] + row[3]) >> 16, 0, 255)


# BT.601 in 16.16 fixed point.
TO_Y, TO_CB, TO_CR = (19595, 38470, 7471, 32768), (-11059, -21709, 32768, 8388608), (32768, -27439, -5329, 8388608)


def _padded(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """The plane with its last row and column repeated."""
    return np.pad(plane, ((0, height - plane.shape[0]), (0, width - plane.shape[1])), "edge")


def components(pixels: np.ndarray, subsample: bool) -> tuple[list[np.ndarray], int, int, int, int]:
    """Planes padded to whole units, the luma factor, and the number of units down and across."""
    height, width = pixels.shape[:2]
    if pixels.shape[2] == 1:
        down, across = -(-height // 8), -(-width // 8)
        return [_padded(pixels[:, :, 0], 8 * down, 8 * across)], 1, 1, down, across
    f = 2 if subsample else 1
    down, across = -(-height // (8 * f)), -(-width // (8 * f))
    planes = [_padded(_fixed(pixels, TO_Y), 8 * f * down, 8 * f * across)]
    small = pixels
    if subsample:
        sums, count = np.zeros((-(-height // 2), -(-width // 2), 3), np.int64), np.zeros((-(-height // 2), -(-width // 2), 1), np.int64)
        for dy in (0, 1):
            for dx in (0, 1):
                cut = pixels[dy::2, dx::2]
                sums[: cut.shape[0], : cut.shape[1]] += cut
                count[: cut.shape[0], : cut.shape[1]] += 1
        small = sums // count
    planes += [_padded(_fixed(small, row), 8 * down, 8 * across) for row in (TO_CB, TO_CR)]
    return planes, f, f, down, across


def blocks(plane: np.ndarray) -> np.ndarray:
    """[row, column, 64] samples of 8 x 8 blocks."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(h // 8, w // 8, 64)


def coefficients(plane: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Quantised DCT coefficients [row, column, 64] in zigzag order, to the nearest even number on ties."""
    b = blocks(plane).reshape(-1, 8, 8).astype(np.float64) - 128
    f = BASIS @ b @ BASIS.T
    q = np.rint(f.reshape(-1, 64) / quant).astype(np.int64)[:, ZIGZAG]
    return q.reshape(plane.shape[0] // 8, plane.shape[1] // 8, 64)


def scan_order(down: int, across: int, f: int, colour: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, block row, block column) of all blocks in the order of the scan."""
    unit = [(0, y, x) for y in range(f) for x in range(f)] + ([(1, 0, 0), (2, 0, 0)] if colour else [])
    comp, dy, dx = (np.array(v) for v in zip(*unit, strict=True))
    my, mx = np.divmod(np.arange(down * across), across)
    luma = np.where(comp == 0, f, 1)
    row, column = my[:, None] * luma + dy, mx[:, None] * luma + dx
    return np.tile(comp, down * across), row.reshape(-1), column.reshape(-1)


def category(v: np.ndarray) -> np.ndarray:
    """Bit length of the absolute value."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _magnitude(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << bits) - 1, v)


def dc_differences(dc: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Each block's DC less that of the block before it of its component, in scan order."""
    out = np.empty_like(dc)
    for c in np.unique(comp):
        out[comp == c] = np.diff(dc[comp == c], prepend=0)
    return out


def symbols(q: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, is DC, symbol, extra bits, their number) of blocks in scan order: runs of zeros, ends of blocks and all."""
    n = len(q)
    at, k = np.nonzero(q[:, 1:])
    k = k + 1
    v = q[at, k]
    before = np.where(np.diff(at, prepend=-1) != 0, 0, np.concatenate([[0], k[:-1]])) if len(k) else k
    run = k - before - 1
    size = category(v)
    long_runs = run // 16
    last = np.zeros(n, np.int64)
    np.maximum.at(last, at, k)
    short = np.flatnonzero(last < 63)
    dc_size = category(diff)
    zero = lambda m: np.zeros(m, np.int64)
    zrl = np.repeat(np.arange(len(k)), long_runs)
    block = np.concatenate([np.arange(n), at, at[zrl], short])
    place = np.concatenate([zero(n), 2 * k + 1, 2 * k[zrl], np.full(len(short), 200)])
    is_dc = np.concatenate([np.ones(n, bool), np.zeros(len(k) + len(zrl) + len(short), bool)])
    symbol = np.concatenate([dc_size, (run % 16) * 16 + size, np.full(len(zrl), 0xF0), zero(len(short))])
    extra = np.concatenate([_magnitude(diff, dc_size), _magnitude(v, size), zero(len(zrl)), zero(len(short))])
    bits = np.concatenate([dc_size, size, zero(len(zrl)), zero(len(short))])
    order = np.argsort(block * 256 + place, kind="stable")
    return tuple(x[order] for x in (block, is_dc, symbol, extra, bits))


def _laid(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bits of codes one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    own = np.repeat(np.arange(len(code)), length)
    shift = np.repeat(ends, length) - 1 - np.arange(total)
    return (code[own] >> shift & 1).astype(np.uint8)


@dataclass
class Options:
    quality: int = 90
    subsample: bool = False
    optimise: bool = True
    segments: tuple[bytes, ...] = ()


def encode(pixels: np.ndarray, options: Options | None = None) -> bytes:
    """A JPEG of uint8 pixels [y, x, 1 or 3]."""
    o = options or Options()
    if pixels.ndim != 3 or not pixels.size:
        raise ValueError("an empty image cannot be encoded")
    height, width, channels = pixels.shape
    if channels not in (1, 3):
        raise ValueError("JPEG has 1 or 3 components here")
    if max(height, width) > 65535:
        raise ValueError("JPEG sides have at most 65535 pixels")
    colour = channels == 3
    planes, fy, _, down, across = components(pixels, o.subsample and colour)
    quants = [scaled(LUMA, o.quality), scaled(CHROMA, o.quality)]
    coefs = [coefficients(p, quants[min(i, 1)]) for i, p in enumerate(planes)]
    comp, row, column = scan_order(down, across, fy, colour)
    q = np.empty((len(comp), 64), np.int64)
    for c in range(len(coefs)):
        own = comp == c
        q[own] = coefs[c][row[own], column[own]]
    diff = dc_differences(q[:, 0], comp)
    kinds = 2 if colour else 1
    parts = [(a, min(a + PART, len(q))) for a in range(0, len(q), PART)]
    if o.optimise:
        counts = np.zeros((2, kinds, 256), np.int64)
        for a, b in parts:
            block, is_dc, symbol, _, _ = symbols(q[a:b], diff[a:b])
            kind = np.minimum(comp[a:b][block], 1)
            for dc in (0, 1):
                for t in range(kinds):
                    counts[dc, t] += np.bincount(symbol[(is_dc == bool(dc)) & (kind == t)], minlength=256)
        tables = [[optimal(counts[dc, t]) for t in range(kinds)] for dc in (0, 1)]
    else:
        tables = [[table(*x) for x in (AC_LUMA, AC_CHROMA)][:kinds], [table(*x) for x in (DC_LUMA, DC_CHROMA)][:kinds]]
    code, length = (np.stack([np.stack([getattr(t, n) for t in row]) for row in tables]) for n in ("code", "length"))
    body, held = [], np.zeros(0, np.uint8)
    for a, b in parts:
        block, is_dc, symbol, extra, bits = symbols(q[a:b], diff[a:b])
        kind = np.minimum(comp[a:b][block], 1)
        own, size = code[is_dc.astype(int), kind, symbol], length[is_dc.astype(int), kind, symbol]
        stream = np.concatenate([held, _laid(own << bits | extra, size + bits)])
        whole = len(stream) // 8 * 8
        body.append(np.packbits(stream[:whole]).tobytes())
        held = stream[whole:]
    if len(held):
        body.append(np.packbits(np.concatenate([held, np.ones(8 - len(held), np.uint8)])).tobytes())
    out = [container.SOI, *o.segments]
    for i in range(kinds):
        out.append(container.segment(0xDB, bytes((i,)) + quants[i][ZIGZAG].astype(np.uint8).tobytes()))
    listed = [(1, 16 * fy + fy if colour else 17, 0)] + ([(2, 17, 1), (3, 17, 1)] if colour else [])
    out.append(container.segment(0xC0, struct.pack(">BHHB", 8, height, width, len(listed)) + b"".join(bytes(x) for x in listed)))
    for t in range(kinds):
        for dc in (1, 0):
            own = tables[dc][t]
            out.append(container.segment(0xC4, bytes(((1 - dc) << 4 | t,)) + bytes(own.counts) + bytes(own.symbols)))
    out.append(container.segment(0xDA, bytes((len(listed),)) + b"".join(bytes((x[0], x[2] * 17)) for x in listed) + bytes((0, 63, 0))))
    return b"".join(out) + b"".join(body).replace(b"\xff", b"\xff\x00") + container.EOI


# decoding ---------------------------------------------------------------------------------------
class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.held, self.n = self.held << 8 | byte, self.n + 8
        self.n -= n
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((length, code))) is not None:
                return found
        raise container.FormatError("no such Huffman code")

    def value(self, bits: int) -> int:
        if not bits:
            return 0
        v = self.take(bits)
        return v if v >> bits - 1 else v - (1 << bits) + 1


def read_coefficients(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """Frame, component of each block in scan order, and its coefficients in zigzag order."""
    segments, _ = container.walk(data)
    quants, codes, frame = {}, {}, None
    for s in segments:
        body = data[s.payload : s.end]
        if s.marker == 0xDB:
            for i in range(0, len(body), 65):
                quants[body[i] & 15] = np.frombuffer(body, np.uint8, 64, i + 1).astype(np.int64)
        elif s.marker == 0xC4:
            at = 0
            while at < len(body):
                counts = list(body[at + 1 : at + 17])
                listed = list(body[at + 17 : at + 17 + sum(counts)])
                made = table(counts, listed)
                codes[body[at]] = {(int(made.length[x]), int(made.code[x])): x for x in listed}
                at += 17 + sum(counts)
        elif s.marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = {"height": height, "width": width, "parts": [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)], "quants": quants}
    if frame is None:
        raise container.FormatError("no baseline frame")
    at = segments[-1].end
    (length,) = struct.unpack_from(">H", data, at + 2)
    scan = data[at + 4 : at + 2 + length]
    used = [(scan[2 + 2 * i] >> 4, scan[2 + 2 * i] & 15) for i in range(scan[0])]
    stop = data.find(container.EOI, at + 2 + length)
    bits = _Bits(data[at + 2 + length : stop if stop >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
    f = frame["parts"][0][1] >> 4 if len(frame["parts"]) > 1 else 1
    down, across = -(-frame["height"] // (8 * f)), -(-frame["width"] // (8 * f))
    comp, row, column = scan_order(down, across, f, len(frame["parts"]) > 1)
    frame |= {"factor": f, "down": down, "across": across, "row": row, "column": column}
    q, last = np.zeros((len(comp), 64), np.int64), [0] * len(frame["parts"])
    for i, c in enumerate(comp.tolist()):
        dc, ac = codes[used[c][0]], codes[16 + used[c][1]]
        last[c] += bits.value(bits.symbol(dc))
        q[i, 0] = last[c]
        k = 1
        while k < 64:
            x = bits.symbol(ac)
            if not x & 15:
                if x != 0xF0:
                    break
                k += 16
                continue
            k += x >> 4
            q[i, k] = bits.value(x & 15)
            k += 1
    return frame, comp, q


def smooth(plane: np.ndarray) -> np.ndarray:
    """A plane of twice the height and width: three parts of the nearest sample and one of the next, down and across, as libjpeg does."""
    for _ in range(2):
        before, after = np.concatenate([plane[:1], plane[:-1]]), np.concatenate([plane[1:], plane[-1:]])
        plane = (np.stack([3 * plane + before, 3 * plane + after], 1) / 4).reshape(-1, plane.shape[1]).T
    return plane


def decode(data: bytes) -> np.ndarray:
    """uint8 pixels [y, x, 1 or 3] of a baseline file; halved chroma is made whole by smooth()."""
    frame, comp, q = read_coefficients(data)
    f, height, width = frame["factor"], frame["height"], frame["width"]
    planes = []
    for c, (_, _, quant) in enumerate(frame["parts"]):
        own = comp == c
        natural = np.zeros((own.sum(), 64))
        natural[:, ZIGZAG] = q[own] * frame["quants"][quant]
        b = BASIS.T @ natural.reshape(-1, 8, 8) @ BASIS + 128
        side = f if c == 0 else 1
        plane = np.zeros((8 * side * frame["down"], 8 * side * frame["across"]))
        for (y, x), v in zip(zip(frame["row"][own], frame["column"][own], strict=True), b, strict=True):
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = v
        planes.append(plane if side == f else smooth(np.clip(plane, 0, 255)[: -(-height // 2), : -(-width // 2)]))
    y, *chroma = (p[:height, :width] for p in planes)
    if not chroma:
        return np.clip(np.rint(y), 0, 255).astype(np.uint8)[:, :, None]
    cb, cr = (p - 128 for p in chroma)
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
