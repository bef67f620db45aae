"""Colour spaces and transfer functions as column expressions; matrices are made on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromaticities of the published colour spaces (red, green, blue, white), each x, y.
PRIMARIES = {
    "srgb": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), (0.3127, 0.3290)),
    "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    "prophoto": ((0.734699, 0.265301), (0.159597, 0.840403), (0.036598, 0.000105), (0.345704, 0.358540)),
    "adobergb": ((0.640, 0.330), (0.210, 0.710), (0.150, 0.060), (0.3127, 0.3290)),
}
D50, D65 = (0.345704, 0.358540), (0.3127, 0.3290)
# The Bradford cone response matrix.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])

# Spellings that the option interface accepts for colour spaces and transfer functions, and the names that reports give.
ALIASES = {
    "auto": "auto", "srgb": "srgb", "sRGB": "srgb", "rec709": "srgb", "p3": "p3", "DisplayP3": "p3", "displayp3": "p3", "rec2020": "rec2020",
    "Rec2020": "rec2020", "bt2020": "rec2020", "prophoto": "prophoto", "ProPhotoRGB": "prophoto", "romm": "prophoto", "adobergb": "adobergb", "AdobeRGB": "adobergb",
}
TRANSFERS = {
    "auto": "auto", "linear": "linear", "srgb": "srgb", "gamma1.8": "gamma18", "gamma18": "gamma18", "gamma2.2": "gamma22", "gamma22": "gamma22", "romm": "romm",
    "prophoto": "romm", "pq": "pq", "rec2100pq": "pq", "hlg": "hlg", "rec2100hlg": "hlg",
}
PRIMARIES_NAMES = {"auto": "auto", "prophoto": "ProPhotoRGB", "srgb": "sRGB", "p3": "DisplayP3", "rec2020": "Rec2020", "adobergb": "AdobeRGB"}
TRANSFER_NAMES = {"auto": "auto", "linear": "linear", "srgb": "srgb", "gamma18": "gamma1.8", "gamma22": "gamma2.2", "romm": "romm", "pq": "pq", "hlg": "hlg"}


def parse_primaries(name: str) -> str:
    key = name
    if key not in ALIASES:
        raise ValueError(f"unknown colour space {name!r}")
    return ALIASES[key]


def parse_transfer(name: str) -> str:
    key = name
    if key not in TRANSFERS:
        raise ValueError(f"unknown transfer function {name!r}")
    return TRANSFERS[key]


def named(c: Column, names: dict[str, str]) -> Column:
    """A column of values looked up in an option table; null where there is no such value."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def _white(xy) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def adaptation(source, target) -> np.ndarray:
    """Bradford adaptation between two white points."""
    a, b = BRADFORD @ _white(source), BRADFORD @ _white(target)
    return np.linalg.inv(BRADFORD) @ np.diag(b / a) @ BRADFORD


def to_xyz(name: str, white=D65) -> np.ndarray:
    """RGB to XYZ relative to a white point."""
    r, g, b, w = PRIMARIES[name]
    m = np.column_stack([_white(x) for x in (r, g, b)])
    m = m * np.linalg.solve(m, _white(w))
    return m if w == white else adaptation(w, white) @ m


def conversion(source: str, target: str) -> np.ndarray:
    return np.eye(3) if source == target else np.linalg.inv(to_xyz(target)) @ to_xyz(source)


def is_identity(m: np.ndarray, eps: float = 1e-6) -> bool:
    return bool(np.abs(m - np.eye(3)).max() <= eps)


def weights(name: str) -> list[float]:
    """Luminance weights of a space's channels."""
    return to_xyz(name)[1].tolist()


def folded_weights(source: str, target: str) -> list[float]:
    """Weights that give target luminance straight from source channels."""
    return (np.array(weights(target)) @ conversion(source, target)).tolist()


def dot(w, r: Column, g: Column, b: Column) -> Column:
    return F.lit(float(w[0])) * r + F.lit(float(w[1])) * g + F.lit(float(w[2])) * b


def convert(m: np.ndarray, r: Column, g: Column, b: Column) -> list[Column]:
    return [r, g, b] if is_identity(m) else [dot(row, r, g, b) for row in m]


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def decode_srgb(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, 2.4))


def encode_srgb(v: Column) -> Column:
    c = clamp(v, 0, 1)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def decode_gamma(v: Column, gamma: float) -> Column:
    return F.when(v <= 0, 0.0).otherwise(F.pow(v, F.lit(gamma)))


def decode_romm(v: Column) -> Column:
    return F.when(v < 0.031248, v / 16).otherwise(F.pow(F.greatest(v, F.lit(0.0)), 1.8))


# SMPTE ST 2084 and ARIB STD-B67.
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32}
HLG = {"a": 0.17883277, "b": 1 - 4 * 0.17883277, "c": 0.55991073}


def decode_pq(v: Column, diffuse_nits: float = 203.0) -> Column:
    p = F.pow(F.greatest(F.lit(0.0), v), 1 / PQ["m2"])
    below = PQ["c2"] - PQ["c3"] * p  # reaches 0 far above the coded range, where light is 0
    light = F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / F.greatest(below, F.lit(1e-300)), 1 / PQ["m1"])
    return F.when(below <= 0, 0.0).otherwise(light * (10000.0 / max(1.0, diffuse_nits)))


def decode_hlg(v: Column, diffuse_nits: float = 203.0) -> Column:
    e = F.greatest(F.lit(0.0), v)
    scene = F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12)
    return F.pow(scene, 1.2) * (1000.0 / max(1.0, diffuse_nits))


def decode_by(transfer: Column, v: Column, diffuse_nits: float = 203.0) -> Column:
    """Light by each row's own transfer function; null for an unknown one."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name in ("linear", "srgb", "gamma18", "gamma22", "romm", "pq", "hlg"):
        out = out.when(transfer == name, decode(name, v, diffuse_nits))
    return out


def convert_by(source: Column, target: str, r: Column, g: Column, b: Column) -> list[Column]:
    """RGB of each row's own space in a target space."""
    made = {n: convert(conversion(n, target), r, g, b) for n in PRIMARIES}
    out = []
    for i in range(3):
        c = F.when(F.lit(False), F.lit(None).cast("double"))
        for n, rgb in made.items():
            c = c.when(source == n, rgb[i])
        out.append(c)
    return out


def decode(transfer: str, v: Column, diffuse_nits: float = 203.0) -> Column:
    made = {
        "linear": lambda: v,
        "srgb": lambda: decode_srgb(v),
        "gamma18": lambda: decode_gamma(v, 1.8),
        "gamma22": lambda: decode_gamma(v, 2.2),
        "romm": lambda: decode_romm(v),
        "pq": lambda: decode_pq(v, diffuse_nits),
        "hlg": lambda: decode_hlg(v, diffuse_nits),
    }
    if transfer not in made:
        raise ValueError(f"unknown transfer function {transfer!r}")
    return made[transfer]()


def resolve_primaries(option: Column, profile: Column) -> Column:
    """Primaries of an image: the option unless auto, else the profile's, else ProPhoto."""
    return F.coalesce(F.when(option != "auto", option), profile, F.lit("prophoto"))


def resolve_transfer(option: Column, is_float: Column, primaries: Column, profile: Column) -> Column:
    """Transfer of an image: the option, else linear for float samples, else the profile's, else by primaries."""
    pro = primaries == "prophoto"
    return (
        F.when(option != "auto", option).when(is_float, "linear").when(profile.isNotNull(), F.when(pro & (profile == "gamma18"), "romm").otherwise(profile)).otherwise(F.when(pro, "romm").otherwise("srgb"))
    )


def ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """BT.601 full range in 16.16 fixed point, clamped to 0..255."""
    rows = ((19595, 38470, 7471, 32768), (-11059, -21709, 32768, 8388608), (32768, -27439, -5329, 8388608))  # fixed values
    return [F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright((x * r + y * g + z * b + k).cast("int"), 16))) for x, y, z, k in rows]


def saturation(r: Column, g: Column, b: Column) -> Column:
    hi = F.greatest(r, g, b)
    return F.when(hi > 1e-6, (hi - F.least(r, g, b)) / hi).otherwise(0.0)


def luminance709(r: Column, g: Column, b: Column) -> Column:
    return dot((0.2126, 0.7152, 0.0722), r, g, b)


def nearest_transfer(x: Column, v: Column) -> Column:
    """Curve that comes nearest to a sampled point; the first listed wins ties."""
    made = {"linear": x, "gamma18": F.pow(x, 1.8), "gamma22": F.pow(x, 2.2), "srgb": decode_srgb(x)}
    return F.array_min(F.array(*[F.struct(F.abs(v - c).alias("error"), F.lit(i).alias("pos"), F.lit(n).alias("name")) for i, (n, c) in enumerate(made.items())]))["name"]
