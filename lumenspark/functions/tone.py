"""Tone curves, highlight compression and gain maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp, encode_srgb

PIVOT = 0.18
# The constants of the filmic curve.
HABLE = (0.15, 0.50, 0.10, 0.20, 0.02, 0.30)
# Spellings that the option interface accepts.
CURVES = {"local": "local", "reinhard": "reinhard", "filmic": "filmic", "clip": "clip", "none": "clip"}


def parse_curve(name: str) -> str:
    if name not in CURVES:
        raise ValueError(f"unknown tone map {name!r}")
    return CURVES[name]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def clip(l: Column) -> Column:
    return F.least(l, F.lit(1.0))


def _hable(x: Column) -> Column:
    a, b, c, d, e, f = HABLE
    return (x * (a * x + c * b) + d * e) / (x * (a * x + b) + d * f) - e / f


def filmic(l: Column, top) -> Column:
    return F.least(F.lit(1.0), _hable(l) / _hable(_c(top)))


def reinhard(l: Column, top) -> Column:
    top = _c(top)
    return F.least(F.lit(1.0), l * (1 + l / (top * top)) / (1 + l))


def curve(name: str, l: Column, top) -> Column:
    return {"clip": lambda: clip(l), "filmic": lambda: filmic(l, top), "reinhard": lambda: reinhard(l, top), "local": lambda: reinhard(l, top)}[parse_curve(name)]()


def shaped(name: str, l: Column, top, lift=0.0, contrast=1.0) -> Column:
    """The curve lifted by stops and given contrast about mid grey."""
    base = curve(name, l, top) * F.pow(F.lit(2.0), F.greatest(_c(lift), F.lit(0.0)))
    c = _c(contrast)
    return F.when(F.abs(c - 1) <= 1e-4, base).otherwise(F.pow(base, c) * F.pow(F.lit(PIVOT), 1 - c))


def scale_for(l: Column, target: Column) -> Column:
    return F.when(l <= 1e-8, 0.0).otherwise(target / F.greatest(l, F.lit(1e-8)))


def log_luminance(l: Column) -> Column:
    return F.greatest(F.lit(-20.0), F.log2(F.greatest(l, F.lit(1e-7))))


def knee_start(max_boost, override: float = 0.0) -> Column:
    return F.lit(float(override)) if override < 0 else -clamp(_c(max_boost) * 0.85, 1.0, 2.5)


def compress_base(b: Column, knee, top) -> Column:
    """Log2 compression: identity up to the knee, then towards 0 as b reaches the top."""
    knee, top = _c(knee), _c(top)
    span, room = -knee, top - knee
    soft = knee + span * (1 - F.exp(-(room / F.nullif(span, F.lit(0.0))) * clamp((b - knee) / F.nullif(room, F.lit(0.0)), 0, 1)))
    return F.when(b <= knee, b).when((span <= 0) | (room <= 0), F.least(b, F.lit(0.0))).otherwise(soft)


def soft_shoulder(v: Column, knee: float) -> Column:
    if knee >= 1:
        return v
    span = 1 - knee
    return F.when(v <= knee, v).otherwise(knee + span * (1 - F.exp(-(v - knee) / span)))


def highlight_scale(r: Column, g: Column, b: Column, s: Column, knee: float) -> Column:
    """One factor for all channels, from the brightest."""
    peak = F.greatest(r, g, b) * s
    return F.when(peak <= 1e-8, s).otherwise(s * soft_shoulder(peak, knee) / F.greatest(peak, F.lit(1e-8)))


def local_scale(l: Column, base: Column, knee, top, detail: float = 1.25, high_knee: float = 0.80) -> Column:
    """Scale to SDR from log base layer and detail, with a second compression near white."""
    from math import log2

    log_s = compress_base(base, knee, top) + detail * (log_luminance(l) - base)
    if high_knee < 1:
        k = log2(high_knee)
        log_s = compress_base(log_s, k, k + 2)
    else:
        log_s = F.least(log_s, F.lit(0.0))
    return F.least(F.lit(1.0), scale_for(l, F.pow(F.lit(2.0), log_s)))


def headroom(peak: Column) -> Column:
    return F.when(peak > 1, F.log2(F.greatest(peak, F.lit(1.0)))).otherwise(0.0)


def max_boost(target, measured: Column, auto: bool = True) -> Column:
    boost = F.greatest(F.least(_c(target), measured), F.lit(0.0)) if auto else _c(target)
    return F.when(boost <= 0, 1e-4).otherwise(boost)


def gain(hdr: Column, sdr: Column, offset: float = 1 / 64) -> Column:
    return F.log2((hdr + offset) / (sdr + offset))


def quantise(g: Column, low, high, gamma: float = 1.0) -> Column:
    return F.round(255 * F.pow(clamp((g - low) / (high - low), 0, 1), gamma)).cast("int")


def restore(sdr: Column, q: Column, low, high, gamma: float = 1.0, weight: float = 1.0, offset: float = 1 / 64) -> Column:
    """HDR from SDR and the quantised gain, at a share of the full headroom."""
    return (sdr + offset) * F.pow(F.lit(2.0), weight * (low + (high - low) * F.pow(q / 255.0, 1 / gamma))) - offset


def ev(a: Column, b: Column) -> Column:
    return F.abs(F.log2(a / b))


def histogram_bin(l: Column) -> Column:
    """Bin of 384 over 2^-14..2^10, 16 to a stop, to the nearest bin centre."""
    return clamp(F.round((F.log2(l) + 14) * 16), 0, 383).cast("int")


def sdr_pixel(hdr: Column, scale: Column) -> Column:
    """8-bit value of a channel: scaled, clamped, coded by sRGB's curve in every space, and rounded."""
    return F.round(255 * encode_srgb(hdr * scale)).cast("int")
