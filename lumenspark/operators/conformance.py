"""Conformance rules of gain map files: a row per rule, and their tallies."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import container as c
from ..codecs import xmp
from ..sources.files import mapped

PROPERTIES = ("hdrgm:GainMapMin", "hdrgm:GainMapMax", "hdrgm:Gamma", "hdrgm:HDRCapacityMax")


def _packets(data: bytes, segments: list[c.Segment]) -> str:
    found = (data[s.payload + len(c.XMP_ID) : s.end].decode("utf-8", "replace") for s in segments if s.marker == 0xE1 and data[s.payload : s.end].startswith(c.XMP_ID))
    return "\n".join(found)


def _index_rules(r: c.Rules, data: bytes, index: dict, end: int) -> None:
    entries = index["entries"]
    r.check("V04", len(entries) in (2, 3), f"{len(entries)} images")
    if len(entries) < 2:
        return
    attributes, size, offset = entries[0]
    r.check("V05", attributes & 0xFFFFFF == c.TYPE_PRIMARY, f"type {attributes & 0xFFFFFF:06x}")
    r.check("V06", attributes & c.REPRESENTATIVE, "representative image")
    r.check("V07", size == end, f"size {size}, found {end}")
    r.check("V07", offset == 0, f"offset {offset}")
    at = end
    for attributes, size, offset in entries[1:]:
        r.check("V08", attributes & 0xFFFFFF == c.TYPE_GAIN, f"type {attributes & 0xFFFFFF:06x}")
        r.check("V08", offset == at - index["base"], f"offset {offset}, expected {at - index['base']}")
        at += size
    r.check("V09", at == len(data), f"images end at {at} of {len(data)}")


def _payload_rules(r: c.Rules, found: dict, components: int | None) -> None:
    r.check("V13", found["alt_headroom"] > 0, f"headroom {found['alt_headroom']:.4f}")
    for low, high, gamma, *_ in found["channels"]:
        r.check("V13", high > low, f"range {low:.4f} to {high:.4f}")
        r.check("V13", gamma > 0, f"gamma {gamma:.4f}")
    r.check("V13", found["multi"] == (components == 3), "channel flag")


def _directory_rules(r: c.Rules, xml: str, actual: int) -> None:
    if not r.check("V14", xmp.NS["Container"] in xml, "directory", required=False):
        return
    r.check("V14", 'Semantic="Primary"' in xml, "names the primary")
    r.check("V14", "GainMap" in xml, "names the gain map")
    length, _ = xmp.property_form("Item:Length", xml)
    if length is not None:
        r.check("V14", length.strip().isdigit() and int(length) == actual, f"length {length}, actual {actual}")


def _parameter_rules(r: c.Rules, xml: str, multi: bool) -> None:
    r.check("V15", xmp.NS["hdrgm"] in xml, "parameters", required=False)
    if "hdr-gain-map" not in xml:
        return
    for name in PROPERTIES:
        r.check("V15", xmp.property_form(name, xml)[0] is not None, name)
    for name in PROPERTIES[:3] if multi else ():
        value, form = xmp.property_form(name, xml)
        commas = (value or "").count(",")
        if commas == 2:
            r.check("V16", form == "seq", f"{name} as {form}")
        else:
            r.check("V16", commas == 0, f"{name} is one value")


def rules_of(data: bytes) -> c.Rules:
    """All rules of one file in order; without an index only the first three can be told."""
    r = c.Rules()
    r.check("V01", data[:2] == c.SOI, "start marker")
    segments, end = c.walk(data)
    r.check("V02", end < len(data), f"primary {end} of {len(data)} bytes")
    index = c.parse_index(data)
    if not r.check("V03", index is not None, "multi-picture index"):
        return r
    _index_rules(r, data, index, end)
    trailer = data[end:]
    r.check("V10", trailer[:2] == c.SOI, "trailer starts")
    r.check("V10", trailer[2:4] in (b"\xff\xe0", b"\xff\xe1", b"\xff\xdb"), f"first marker {trailer[2:4].hex()}")
    r.check("V10", trailer.rstrip(b"\x00")[-2:] == c.EOI, "trailer ends")
    own, stop = c.walk(data, end)
    frame = next((s for s in own if s.marker in (0xC0, 0xC1, 0xC2) and s.size >= 6), None)
    components = data[frame.payload + 5] if frame else None
    if frame:
        height, width = struct.unpack_from(">HH", data, frame.payload + 1)
        r.check("V11", components in (1, 3), f"{components} channels, {width}x{height}")
        if xmp.AUXILIARY.encode() in data[end:stop]:
            r.check("V11", components == 1, "the vendor block needs one channel")
        else:
            r.check("V11", components == 3, "three channels", required=False)
    marked = any(s.marker == 0xE2 and s.size == 32 and data[s.payload : s.end].startswith(c.URN) for s in segments)
    r.check("V12", marked, "base image marker")
    at = c.find(data, own, 0xE2, c.URN)
    place = at.payload if at else data.find(c.URN)
    found = None
    if place >= 0:
        try:
            found = c.parse_payload(data[place:])
        except (struct.error, IndexError):
            found = None
    if r.check("V13", found is not None, "gain map payload"):
        _payload_rules(r, found, components)
    _directory_rules(r, _packets(data, segments), index["entries"][1][1] if len(index["entries"]) >= 2 else len(trailer))
    _parameter_rules(r, _packets(data, own), bool(found and found["multi"]))
    return r


def rules(files: DataFrame) -> DataFrame:
    """(path, seq, rule, required, passed, detail) over files(path, content)."""

    def run(path, content) -> Iterator[tuple]:
        for i, row in enumerate(rules_of(content or b"")):
            yield (path, i, *row)

    return mapped(files.select("path", "content"), run, "path string, seq int, rule string, required boolean, passed boolean, detail string")


def tally(rows: DataFrame, keys=("path",)) -> DataFrame:
    """Per file: rules passed, failed and warned about, and whether it conforms (no required rule failed)."""
    bad, need = ~F.col("passed"), F.col("required")
    out = rows.groupBy(*keys).agg(F.count_if(F.col("passed")).alias("passed"), F.count_if(bad & need).alias("failed"), F.count_if(bad & ~need).alias("warned"))
    return out.withColumn("conforms", F.col("failed") == 0)
