"""One image in two passes over bands of rows: measure, then map to an SDR base and a gain map.

The column expressions of `functions` are the definition; this is the same in numpy for the one
task that encodes an image, so that a raster is never spread into rows of pixels only to be
gathered again. Memory: the source raster, its 8-bit base and the gains; all else is per band.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..functions import color, tone
from ..plans.options import EncodeOptions
from .icc import decoded_srgb

BAND_ROWS = 64
BINS, LOWEST, PER_STOP = 384, -14, 16


def light(transfer: str, v: np.ndarray, nits: float) -> np.ndarray:
    """Linear light of coded values."""
    v = v.astype(np.float64)
    up = np.maximum(v, 0)
    if transfer == "linear":
        return v
    if transfer == "srgb":
        return np.where(v <= 0.04045, v / 12.92, decoded_srgb(up))
    if transfer in ("gamma18", "gamma22"):
        return up ** (1.8 if transfer == "gamma18" else 2.2)
    if transfer == "romm":
        return np.where(v < 0.031248, v / 16, up**1.8)
    if transfer == "pq":
        p = up ** (1 / color.PQ["m2"])
        below = color.PQ["c2"] - color.PQ["c3"] * p
        y = (np.maximum(p - color.PQ["c1"], 0) / np.where(below > 0, below, 1)) ** (1 / color.PQ["m1"])
        return np.where(below > 0, y, 0) * 10000 / max(1.0, nits)
    if transfer == "hlg":
        scene = np.where(up <= 0.5, up * up / 3, (np.exp((up - color.HLG["c"]) / color.HLG["a"]) + color.HLG["b"]) / 12)
        return scene**1.2 * 1000 / max(1.0, nits)
    raise ValueError(f"unknown transfer function {transfer!r}")


def coded_srgb(v: np.ndarray) -> np.ndarray:
    c = np.clip(v, 0, 1)
    return np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)


def half_up(v: np.ndarray) -> np.ndarray:
    return np.floor(v + 0.5)


def cell_means(v: np.ndarray, block: int) -> np.ndarray:
    """Means over block x block cells [y, x, ...]; cells at the far edges are smaller."""
    ys, xs = np.arange(0, v.shape[0], block), np.arange(0, v.shape[1], block)
    sums = np.add.reduceat(np.add.reduceat(v, ys, 0), xs, 1)
    n = np.diff([*ys, v.shape[0]])[:, None] * np.diff([*xs, v.shape[1]])[None, :]
    return sums / n.reshape(n.shape + (1,) * (v.ndim - 2))


def moving_mean(v: np.ndarray, radius: int) -> np.ndarray:
    """Separable mean of 2 * radius + 1 samples with the edges repeated, by running sums."""
    for axis in (1, 0):
        pad = [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)]
        run = np.cumsum(np.pad(v, pad, "edge"), axis)
        n = v.shape[axis]
        v = (np.take(run, range(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(run, range(n), axis)) / (2 * radius + 1)
    return v


def guided(v: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """Edge-keeping smoothing of a plane by itself."""
    m = moving_mean(v, radius)
    var = np.maximum(moving_mean(v * v, radius) - m * m, 0)
    a = var / (var + eps)
    return moving_mean(a, radius) * v + moving_mean(m * (1 - a), radius)


def _compress(b: np.ndarray, knee: float, top: float) -> np.ndarray:
    span, room = -knee, top - knee
    if span <= 0 or room <= 0:
        return np.where(b <= knee, b, np.minimum(b, 0))
    return np.where(b <= knee, b, knee + span * (1 - np.exp(-(room / span) * np.clip((b - knee) / room, 0, 1))))


def _curve(name: str, l: np.ndarray, top: float) -> np.ndarray:
    if name == "clip":
        return np.minimum(l, 1)
    if name == "filmic":
        a, b, c, d, e, f = tone.HABLE
        h = lambda x: (x * (a * x + c * b) + d * e) / (x * (a * x + b) + d * f) - e / f
        return np.minimum(1, h(l) / h(top))
    return np.minimum(1, l * (1 + l / top**2) / (1 + l))


@dataclass
class Solved:
    lift: float = 0.0
    contrast: float = 1.0
    anchor: float = 0.0


def quantile(hist: np.ndarray, f: float) -> float:
    """Centre of the first bin whose running count reaches floor(f * total); 0 without samples."""
    total = int(hist.sum())
    if not total:
        return 0.0
    return 2.0 ** (LOWEST + int(np.searchsorted(np.cumsum(hist), math.floor(f * total))) / PER_STOP) if math.floor(f * total) else 2.0**LOWEST


def solve(hist: np.ndarray, name: str, max_boost: float) -> Solved:
    """Lift and contrast that give the base the scene's mid tones and part of its spread."""
    if not hist.sum():
        return Solved()
    top = max(1.0001, 2.0**max_boost)
    t = lambda v: float(_curve(name, np.array(v), top))
    q1, a, q3 = (min(1.0, quantile(hist, f)) for f in (0.25, 0.5, 0.75))
    contrast = 1.0
    if 0 < q1 < q3 and 0 < t(q1) < t(q3) and (got := math.log2(t(q3) / t(q1))) > 1e-4:
        contrast = min(1.5, max(1.0, 1 + 0.4 * (math.log2(q3 / q1) / got - 1)))
    lift = min(1.5, max(0.0, math.log2((a / tone.PIVOT ** (1 - contrast)) ** (1 / contrast) / t(a)))) if t(a) > 0 and a > 0 else 0.0
    return Solved(lift, contrast, a)


@dataclass
class Rendered:
    """8-bit base [y, x, 3] and gain map [y, x, 1 or 3] with the ranges and measurements that go with them."""

    sdr: np.ndarray
    gain: np.ndarray
    lo: tuple = (0.0, 0.0, 0.0)
    hi: tuple = (0.0, 0.0, 0.0)
    declared: float = 0.0
    stats: dict = field(default_factory=dict)


def render(v: np.ndarray, o: EncodeOptions, primaries: str, transfer: str) -> Rendered:
    """Base and gain map of coded values [y, x, 1 or 3] in a given space."""
    height, width = v.shape[:2]
    matrix, w = color.conversion(primaries, o.color_space), np.array(color.weights(o.color_space))
    edge = max(height, width)
    block = 1 if o.peak_detect == "exact" else max(-(-edge // 2048), 2 if edge > 512 else 1)
    cell = max(1, -(-edge // 1024))
    step = math.lcm(block, cell, o.subsample)
    step *= max(1, BAND_ROWS // step)
    bands = [(y, min(y + step, height)) for y in range(0, height, step)]

    def hdr(a: int, b: int) -> np.ndarray:
        lin = light(transfer, v[a:b], o.diffuse_white)
        lin = np.repeat(lin, 3, 2) if lin.shape[2] == 1 else lin
        return lin if color.is_identity(matrix) else lin @ matrix.T

    hist, ceiling, softened, peak, guide = np.zeros(BINS, np.int64), np.zeros(3), 0.0, 0.0, []
    for a, b in bands:
        rgb = hdr(a, b)
        l = np.maximum(rgb @ w, 0)
        means = cell_means(l, block)
        softened, peak = max(softened, float(means.max())), max(peak, float(l.max()))
        ceiling = np.maximum(ceiling, cell_means(np.maximum(rgb, 0), block).max((0, 1)))
        positive = means[means > 0]
        bins = np.clip(half_up((np.log2(positive) - LOWEST) * PER_STOP), 0, BINS - 1).astype(int)
        hist += np.bincount(bins, minlength=BINS)
        guide.append(cell_means(l, cell))
    stops = lambda p: math.log2(p) if p > 1 else 0.0
    boost = max(min(o.headroom, stops(softened)), 0.0) if o.auto_max_boost else o.headroom
    boost = boost if boost > 0 else 1e-4
    local = o.tone_map == "local"
    shape = Solved() if local else Solved(o.sdr_lift, o.sdr_contrast)
    if local:
        plane = np.maximum(-20, np.log2(np.maximum(np.concatenate(guide), 1e-7)))
        base = guided(plane, max(2, max(plane.shape) // 16), max(1e-3, o.sdr_edge))
        knee = o.sdr_knee if o.sdr_knee < 0 else -min(max(0.85 * boost, 1.0), 2.5)
        high = 0.0 if o.highlight_knee >= 1 else math.log2(o.highlight_knee)
    elif o.shape == "auto":
        shape = solve(hist, o.tone_map, boost)
    top = max(1.0001, 2.0**boost)

    def scale(l: np.ndarray, a: int, b: int) -> np.ndarray:
        if not local:
            made = _curve(o.tone_map, l, top) * 2.0 ** max(shape.lift, 0.0)
            if abs(shape.contrast - 1) > 1e-4:
                made = made**shape.contrast * tone.PIVOT ** (1 - shape.contrast)
            return np.where(l <= 1e-8, 0, made / np.maximum(l, 1e-8))
        fy, fx = (np.arange(a, b) + 0.5) / cell - 0.5, (np.arange(width) + 0.5) / cell - 0.5
        y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
        ya, yb = (np.clip(y0 + d, 0, base.shape[0] - 1) for d in (0, 1))
        xa, xb = (np.clip(x0 + d, 0, base.shape[1] - 1) for d in (0, 1))
        ty, tx = (fy - y0)[:, None], (fx - x0)[None, :]
        under = (base[np.ix_(ya, xa)] * (1 - tx) + base[np.ix_(ya, xb)] * tx) * (1 - ty) + (base[np.ix_(yb, xa)] * (1 - tx) + base[np.ix_(yb, xb)] * tx) * ty
        log_l = np.maximum(-20, np.log2(np.maximum(l, 1e-7)))
        log_s = _compress(_compress(under, knee, boost) + o.sdr_detail * (log_l - under), high, high + 2)
        return np.where(l > 1e-8, np.minimum(1, 2.0**log_s / np.maximum(l, 1e-8)), 0)

    sdr8 = np.empty((height, width, 3), np.uint8)
    gains = []
    for a, b in bands:
        rgb = np.clip(hdr(a, b), 0, ceiling)
        l = np.maximum(rgb @ w, 0)
        s = scale(l, a, b)
        bright = rgb.max(2) * s
        span = 1 - o.highlight_knee
        if span > 0:
            soft = o.highlight_knee + span * (1 - np.exp(-np.maximum(bright - o.highlight_knee, 0) / span))
            s = np.where((bright > o.highlight_knee) & (bright > 1e-6), s * soft / np.maximum(bright, 1e-6), s)
        sdr = np.clip(rgb * s[:, :, None], 0, 1)
        sdr8[a:b] = half_up(coded_srgb(sdr) * 255).astype(np.uint8)
        if o.multi:
            g = np.log2((rgb + o.offset_hdr) / (sdr + o.offset_sdr))
        else:
            g = np.log2((l + o.offset_hdr) / (np.clip(sdr @ w, 0, 1) + o.offset_sdr))[:, :, None]
        gains.append(cell_means(g, o.subsample))
    g = np.concatenate(gains)
    lo = np.minimum(0, g.min((0, 1)))
    hi = np.maximum(lo + 1e-4, g.max((0, 1)))
    q = half_up(255 * np.clip((g - lo) / (hi - lo), 0, 1) ** o.gamma).astype(np.uint8)
    spread = lambda x: tuple(float(k) for k in (x if len(x) == 3 else np.repeat(x, 3)))
    total = int(hist.sum())
    white = int(np.clip(half_up(np.array(-LOWEST * PER_STOP)), 0, BINS - 1))
    stats = {
        "measuredHeadroom": stops(softened), "truePeakHeadroom": stops(peak), "sdrLiftEV": shape.lift, "sdrContrast": shape.contrast, "midtoneAnchor": shape.anchor,
        "aboveSdrWhite": float(hist[white + 1 :].sum() / total) if total else 0.0, "autoShaped": o.shape == "auto" and not local,
    }
    return Rendered(sdr8, q, spread(lo), spread(hi), boost, stats)


def restore(sdr8: np.ndarray, gain: np.ndarray, m, subsample: int, weight: float = 1.0) -> np.ndarray:
    """HDR light [y, x, 3] from a decoded base, gain map and its metadata, at a share of the headroom; gains are repeated over their cells."""
    s = decoded_srgb(sdr8.astype(np.float64) / 255)
    q = np.repeat(np.repeat(gain.astype(np.float64) / 255, subsample, 0), subsample, 1)[: s.shape[0], : s.shape[1]]
    lo, hi, gamma, base, alt = (np.array(x) for x in (m.lo, m.hi, m.gamma, m.base_offset, m.alt_offset))
    return (s + base) * 2.0 ** (weight * (lo + (hi - lo) * q ** (1 / gamma))) - alt
