"""Colour profiles: building RGB and grey ones, and finding out what an unknown one means."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions import color

# Codes of the coding-independent code points tag, and the white point that profiles state.
CODE_TRANSFER = {8: "linear", 13: "srgb", 16: "pq", 18: "hlg", 1: "gamma22", 6: "gamma22", 14: "gamma22", 15: "gamma22"}
CODE_PRIMARIES = {1: "srgb", 9: "rec2020", 12: "p3"}
WHITE = (0.3457, 0.3585)
NAMES = {"p3": "Display P3", "rec2020": "Rec. ITU-R BT.2020"}
NAME_OTHERWISE = "sRGB IEC61966-2.1"
#: Spaces in the order in which ties are decided.
CANDIDATES = ("prophoto", "rec2020", "p3", "adobergb", "srgb")
CURVE_POINTS = 1024
MATCH = 0.05


def fixed(v: float) -> bytes:
    return struct.pack(">i", int(np.floor(v * 65536 + 0.5)) if v >= 0 else -int(np.floor(0.5 - v * 65536)))


def _typed(kind: bytes, body: bytes) -> bytes:
    return kind + bytes(4) + body


def _numbers(kind: bytes, values) -> bytes:
    return _typed(kind, b"".join(fixed(float(v)) for v in values))


def _described(name: str) -> bytes:
    raw = name.encode("ascii") + b"\x00"
    return _typed(b"desc", struct.pack(">I", len(raw)) + raw + bytes(4 + 4 + 2 + 1 + 67))


def _white() -> tuple[float, float, float]:
    x, y = WHITE
    return x / y, 1.0, (1 - x - y) / y


def decoded_srgb(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def srgb_curve() -> bytes:
    points = np.floor(decoded_srgb(np.linspace(0, 1, CURVE_POINTS)) * 65535 + 0.5)
    return _typed(b"curv", struct.pack(">I", CURVE_POINTS) + points.astype(">u2").tobytes())


def gamma_curve(gamma: float) -> bytes:
    return _typed(b"curv", struct.pack(">IH", 1, int(gamma * 256 + 0.5)))


def _assembled(space: bytes, tags: list[tuple[bytes, bytes]]) -> bytes:
    """Header, tag table, and tag data on four-byte bounds."""
    at, table, body = 128 + 4 + 12 * len(tags), struct.pack(">I", len(tags)), b""
    for name, data in tags:
        table += name + struct.pack(">II", at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    head = struct.pack(">I4sI4s4s4s6H4s4s", at + len(body), b"none", 0x02400000, b"mntr", space, b"XYZ ", 2025, 1, 1, 0, 0, 0, b"acsp", b"APPL")
    head += bytes(24) + b"".join(map(fixed, _white())) + b"LMNS"
    return head.ljust(128, b"\x00") + table + body


def rgb_profile(space: str) -> bytes:
    """Matrix profile of a colour space with the sRGB curve in 1024 points; colorants are adapted to D50."""
    adapted = color.adaptation(color.D65, color.D50)
    colorants = adapted @ color.to_xyz(space)
    curve = srgb_curve()
    tags = [(b"desc", _described(NAMES.get(space, NAME_OTHERWISE))), (b"wtpt", _numbers(b"XYZ ", _white()))]
    tags += [(n + b"XYZ", _numbers(b"XYZ ", colorants[:, i])) for i, n in enumerate((b"r", b"g", b"b"))]
    tags += [(n + b"TRC", curve) for n in (b"r", b"g", b"b")]
    tags += [(b"chad", _numbers(b"sf32", adapted.reshape(-1))), (b"cprt", _typed(b"text", b"No rights reserved.\x00"))]
    return _assembled(b"RGB ", tags)


def grey_profile(gamma: float, name: str) -> bytes:
    return _assembled(b"GRAY", [(b"desc", _described(name)), (b"wtpt", _numbers(b"XYZ ", _white())), (b"kTRC", gamma_curve(gamma)), (b"cprt", _typed(b"text", b"No rights reserved.\x00"))])


@dataclass
class Summary:
    valid: bool = False
    grey: bool = False
    description: str = ""
    primaries: str | None = None
    transfer: str | None = None


def gamma_class(g: float) -> str:
    return "linear" if abs(g - 1) < 0.02 else "gamma18" if abs(g - 1.8) < 0.05 else "gamma22"


def nearest_transfer(x: float, v: float) -> str:
    """Curve nearest to a sampled point; the first listed wins ties."""
    made = {"linear": x, "gamma18": x**1.8, "gamma22": x**2.2, "srgb": float(decoded_srgb(np.array(x)))}
    return min(made, key=lambda n: abs(v - made[n]))


def _curve_class(tag: bytes) -> str | None:
    if len(tag) < 12:
        return None
    kind, (n,) = tag[:4], struct.unpack_from(">I", tag, 8)
    if kind == b"curv":
        if n == 0:
            return "linear"
        if n == 1:
            return gamma_class(struct.unpack_from(">H", tag, 12)[0] / 256) if len(tag) >= 14 else None
        if n >= 3 and 12 + 2 * n <= len(tag):
            middle = n // 2
            return nearest_transfer(middle / (n - 1), struct.unpack_from(">H", tag, 12 + 2 * middle)[0] / 65535)
        return None
    if kind != b"para":
        return None
    if n >> 16 == 0 and len(tag) >= 16:
        return gamma_class(struct.unpack_from(">i", tag, 12)[0] / 65536)
    return "srgb"


def nearest_space(colorants: np.ndarray) -> str | None:
    """Space whose D50 colorants (3 x 3, a column each) differ least in sum, if by under MATCH."""
    adapted = color.adaptation(color.D65, color.D50)
    errors = {n: float(np.abs(adapted @ color.to_xyz(n) - colorants).sum()) for n in CANDIDATES}
    best = min(CANDIDATES, key=errors.__getitem__)
    return best if errors[best] < MATCH else None


def inspect(profile: bytes | None) -> Summary:
    """Meaning of a profile; a damaged one gives valid = False and never an error."""
    s = Summary()
    if profile is None or len(profile) < 132 or struct.unpack_from(">I", profile)[0] > len(profile):
        return s
    s.grey = profile[16:20] == b"GRAY"
    (count,) = struct.unpack_from(">I", profile, 128)
    if count > 256 or 132 + 12 * count > len(profile):
        return s
    tags: dict[bytes, bytes] = {}
    for i in range(count):
        name, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * i)
        if name not in tags:
            tags[name] = profile[at : at + size] if at + size <= len(profile) else b""
    described = tags.get(b"desc", b"")
    if len(described) > 12:
        (n,) = struct.unpack_from(">I", described, 8)
        if 0 < n <= len(described) - 12:
            s.description = described[12 : 11 + n].decode("latin-1")
    codes = tags.get(b"cicp", b"")
    if len(codes) >= 12:
        s.primaries, s.transfer = CODE_PRIMARIES.get(codes[8]), CODE_TRANSFER.get(codes[9])
    if s.transfer is None:
        s.transfer = _curve_class(tags.get(b"kTRC" if s.grey else b"rTRC", b""))
    colorants = [tags.get(n + b"XYZ", b"") for n in (b"r", b"g", b"b")]
    if not s.grey and s.primaries is None and all(len(c) >= 20 for c in colorants):
        s.primaries = nearest_space(np.column_stack([np.frombuffer(c, ">i4", 3, 8) / 65536 for c in colorants]))
    s.valid = True
    return s
