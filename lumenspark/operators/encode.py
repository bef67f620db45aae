"""Encoding: one rendered TIFF in, one gain map JPEG with its report out, a row per file.

A file is one row from scan to sink, so any number of images needs no shuffle: each is decoded,
measured, mapped, coded and assembled in the task that read it. A file that fails gives a row with
its error and no bytes; nothing partial is written.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import container, exif, icc, jpeg, render, tiff, xmp
from ..functions import color
from ..plans.options import EncodeOptions
from ..sources.files import mapped

REPORT = "width int, height int, gainWidth int, gainHeight int, gainChannels int, primaryBytes long, gainMapBytes long, totalBytes long, minBoostLog2 double, maxBoostLog2 double, declaredHeadroom double, measuredHeadroom double, truePeakHeadroom double, autoShaped boolean, sdrLiftEV double, sdrContrast double, midtoneAnchor double, aboveSdrWhite double, inputPrimaries string, inputTransfer string, seconds double"
#: Decimals of the report's numbers (fixed values of its format).
DECIMALS = {"midtoneAnchor": 5, "seconds": 3}


def resolve_space(o: EncodeOptions, is_float: bool, profile: icc.Summary) -> tuple[str, str]:
    """(primaries, transfer) of an image: option, float samples, profile, in this order; else ProPhoto and its curve, or sRGB's."""
    known = profile if profile.valid else icc.Summary()
    space = o.input_primaries if o.input_primaries != "auto" else known.primaries or "prophoto"
    if o.input_transfer != "auto":
        return space, o.input_transfer
    if is_float:
        return space, "linear"
    if known.transfer:
        return space, "romm" if space == "prophoto" and known.transfer == "gamma18" else known.transfer
    return space, "romm" if space == "prophoto" else "srgb"


def metadata(r: render.Rendered, o: EncodeOptions) -> container.GainMeta:
    three = lambda v: (v,) * 3
    return container.GainMeta(o.multi, True, o.apple, 0.0, max(r.declared, 0.05), r.lo, r.hi, three(o.gamma), three(o.offset_sdr), three(o.offset_hdr))


def assemble(r: render.Rendered, o: EncodeOptions, exif_payload: bytes = b"") -> tuple[bytes, int, int]:
    """The file of a rendered image, and the sizes of its two images. The gain map comes first, as the base states its length."""
    m = metadata(r, o)
    own = [container.jfif(), container.segment(0xE2, container.payload(m))] + ([container.xmp(xmp.gain_map(m))] if o.xmp else [])
    gain = jpeg.encode(r.gain, jpeg.Options(o.gainmap_quality, False, o.optimise, tuple(own)))
    head = [container.jfif(multi_picture=True)] + ([container.segment(0xE1, exif_payload)] if exif_payload else [])
    head += [container.index_placeholder(), container.base_marker()]
    head += [container.xmp(xmp.primary(len(gain)))] if o.xmp else []
    head += container.icc(icc.rgb_profile(o.color_space)) if o.icc else []
    primary = jpeg.encode(r.sdr, jpeg.Options(o.quality, o.chroma_subsample, o.optimise, tuple(head)))
    return container.concat(primary, gain), len(primary), len(gain)


def encode(content: bytes, o: EncodeOptions) -> tuple[bytes, dict]:
    """A gain map JPEG of a TIFF, and the report of how it was made."""
    begun = time.monotonic()
    h, v = tiff.decode(content)
    space, transfer = resolve_space(o, h.is_float, icc.inspect(h.icc))
    lifted = b""
    if o.exif:
        dirs = {n: exif.carried(content, at, h.little, n) for n, at in (("ifd0", h.ifd0), ("exif", h.exif), ("gps", h.gps)) if at is not None}
        lifted = exif.app_payload(exif.completed(dirs, h.width, h.height, o.color_space == "srgb"))
    r = render.render(v, o, space, transfer)
    data, primary, gain = assemble(r, o, lifted)
    report = {
        "width": h.width, "height": h.height, "gainWidth": r.gain.shape[1], "gainHeight": r.gain.shape[0], "gainChannels": r.gain.shape[2],
        "primaryBytes": primary, "gainMapBytes": gain, "totalBytes": len(data), "minBoostLog2": r.lo[0], "maxBoostLog2": r.hi[0], "declaredHeadroom": max(r.declared, 0.05),
        **r.stats, "inputPrimaries": color.PRIMARIES_NAMES[space], "inputTransfer": color.TRANSFER_NAMES[transfer], "seconds": time.monotonic() - begun,
    }
    return data, report


def report_json(report: dict) -> str:
    """The one-line report."""
    rounded = {k: round(v, DECIMALS.get(k, 4)) if isinstance(v, float) else v for k, v in report.items()}
    return json.dumps({"ok": True, **rounded}, separators=(",", ":"))


_FIELDS = [f.split()[0] for f in REPORT.split(", ")]


def encode_files(files: DataFrame, options: EncodeOptions | None = None) -> DataFrame:
    """(path, ok, error, report, content) of files(path, content)."""
    o = replace(options or EncodeOptions()).check()

    def run(path, content) -> Iterator[tuple]:
        try:
            data, report = encode(bytes(content or b""), o)
        except (ValueError, MemoryError) as e:
            yield path, False, str(e) or type(e).__name__, None, None
            return
        yield path, True, None, {k: report[k] for k in _FIELDS}, data

    return mapped(files.select("path", "content"), run, f"path string, ok boolean, error string, report struct<{', '.join(f.replace(' ', ': ', 1) for f in REPORT.split(', '))}>, content binary")


def json_reports(encoded: DataFrame) -> DataFrame:
    """(path, json): the one-line report of each encoded file."""
    fields = [F.lit(True).alias("ok")]
    for name, kind in (f.split() for f in REPORT.split(", ")):
        c = F.col(f"report.{name}")
        fields.append((F.round(c, DECIMALS.get(name, 4)) if kind == "double" else c).alias(name))
    return encoded.where("ok").select("path", F.to_json(F.struct(*fields)).alias("json"))


def batch(encoded: DataFrame) -> DataFrame:
    """(total, exported, failures, reasons): the tallies of a batch, and each distinct reason of failure with its count."""
    each = encoded.groupBy("ok", "error").agg(F.count("*").alias("n"))
    reason = F.when(~F.col("ok"), F.struct(F.coalesce("error", F.lit("")).alias("reason"), "n"))
    return each.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("exported"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("failures"), F.array_sort(F.collect_list(reason)).alias("reasons"))


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """(path, bytes) of the files written: one for each row that has bytes, under its own name in a shared folder.

    A file is written under a temporary name, checked for its length, and renamed, so a task that is
    run again or lost leaves no partial file; an existing file is not overwritten by another name.
    """

    def run(path, content) -> Iterator[tuple]:
        final = os.path.join(folder, os.path.basename(path))
        part = f"{final}.{os.getpid()}.part"
        try:
            with open(part, "wb") as f:
                f.write(content)
            if os.path.getsize(part) != len(content):
                raise OSError(f"short write to {part}")
            os.replace(part, final)
        finally:
            if os.path.exists(part):
                os.remove(part)
        yield final, len(content)

    return mapped(encoded.where("content IS NOT NULL").select("path", "content"), run, "path string, bytes long")


def manifest(written: DataFrame, added_by: str = "export") -> DataFrame:
    """Rows to append to a catalogue table: each written file once."""
    return written.dropDuplicates(["path"]).select("path", "bytes", F.lit(added_by).alias("added_by"))


def reconstruction(content: bytes, subsample: int, weight: float = 1.0) -> np.ndarray:
    """HDR light of a gain map JPEG as a decoder sees it: images split, payload read, base and map decoded."""
    primary, gain = container.split(content)[:2]
    segments, _ = container.walk(gain)
    own = container.find(gain, segments, 0xE2, container.URN)
    found = container.parse_payload(gain[own.payload : own.end])
    rows = found["channels"] * (1 if found["multi"] else 3)
    m = container.GainMeta(found["multi"], found["use_base"], False, 0.0, found["alt_headroom"], *map(tuple, zip(*rows, strict=True)))
    return render.restore(jpeg.decode(primary), jpeg.decode(gain), m, subsample, weight)
