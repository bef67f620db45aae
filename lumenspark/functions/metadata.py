"""Builders of gain map metadata as column expressions: payload, index, segments, and property text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codecs import container, xmp
from . import binary
from .bind import bound


def _digits(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if pd.isna(x) else xmp.number(x))


def significant(v: Column) -> Column:
    """Six significant digits; no built-in formats like this."""
    return F.pandas_udf(_digits, "string")(v)


def payload(multi: Column, use_base: Column, base_headroom: Column, alt_headroom: Column, lo: Column, hi: Column, gamma: Column, base_offset: Column, alt_offset: Column) -> Column:
    """Gain map payload: 89 bytes with one channel, 169 with three. The five parameters are arrays of three."""
    flags = F.when(multi, 0x80).otherwise(0) + F.when(use_base, 0x40).otherwise(0)
    head = F.concat(binary.raw(container.URN), binary.u16(0), binary.u16(1), binary.u8(flags), binary.rational(base_headroom), binary.rational(alt_headroom))
    channel = lambda c: F.concat(binary.srational(lo[c]), binary.srational(hi[c]), binary.rational(gamma[c]), binary.srational(base_offset[c]), binary.srational(alt_offset[c]))
    return F.concat(head, channel(0), F.when(multi, F.concat(channel(1), channel(2))).otherwise(binary.raw(b"")))


def segment(marker: int, body: Column) -> Column:
    """A marker segment; null where the body is too long for one."""
    made = lambda b: F.when(F.length(b) + 2 <= 65535, F.concat(binary.raw(bytes((0xFF, marker))), binary.u16(F.length(b) + 2), b))
    return bound(body, made)


def index_body(sizes: Column, endian: Column) -> Column:
    """Multi-picture index of images of these sizes (an array), for an index whose byte-order field lies at a place in the file."""
    n = F.size(sizes)
    fixed = container.index_body([0], [0], [0])
    at = len(fixed) - container.ENTRY
    head = F.concat(binary.raw(fixed[: 4 + 8 + 2 + 12 + 8]), binary.u32(n), binary.raw(fixed[36 - 2 + 4 : 36 - 2 + 4 + 4]), binary.u32(n * container.ENTRY), binary.raw(fixed[46:at]))
    place = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)
    entry = lambda i: F.concat(
        binary.u32(F.when(i == 0, container.REPRESENTATIVE | container.TYPE_PRIMARY).otherwise(container.TYPE_GAIN)),
        binary.u32(F.element_at(sizes, i + 1)), binary.u32(F.when(i == 0, 0).otherwise(place(i) - endian)), binary.u32(0),
    )
    entries = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), entry), binary.raw(b""), lambda s, x: F.concat(s, x))
    return F.concat(head, entries)


def icc_chunks(profile: Column) -> Column:
    """Array of the colour profile segments of a profile, in order."""
    return bound(profile, _icc_chunks)


def _icc_chunks(profile: Column) -> Column:
    n = F.ceil(F.length(profile) / container.ICC_CHUNK).cast("int")
    chunk = lambda i: segment(0xE2, F.concat(binary.raw(container.ICC_ID), binary.u8(i), binary.u8(n), F.substring(profile, (i - 1) * container.ICC_CHUNK + 1, F.lit(container.ICC_CHUNK))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), chunk)).otherwise(F.array().cast("array<binary>"))


# XMP as text ------------------------------------------------------------------------------------
def property_value(name: str, xml: Column) -> Column:
    """Text of a property, written as an attribute or as an element; null if it is absent."""
    return property_form(name, xml)["value"]


def property_form(name: str, xml: Column) -> Column:
    """(value, form) of a property: form is attribute, seq, or null; items of a sequence are joined by ', '."""
    own = re.escape(name)
    attribute, whole = own + r'\s*=\s*"([^"]*)"', f"(?s)<{own}>(.*?)</{own}>"
    body = F.regexp_extract(xml, whole, 1)
    items = F.transform(F.regexp_extract_all(body, F.lit(r"<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1)), lambda i: F.trim(i))
    by_attribute, by_element = F.regexp_like(xml, F.lit(attribute)), F.regexp_like(xml, F.lit(whole))
    value = F.when(by_attribute, F.regexp_extract(xml, attribute, 1)).when(by_element, F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.trim(body)))
    return F.struct(value.alias("value"), F.when(by_attribute, "attribute").when(by_element, "seq").alias("form"))


def merged(xml: Column, block: Column) -> Column:
    """A packet with one more description before its end."""
    return F.replace(xml, F.lit("</rdf:RDF>"), F.concat(block, F.lit("</rdf:RDF>")))


def primary_packet(gain_bytes: Column) -> Column:
    """XMP directory of a base image whose gain map has so many bytes."""
    before, after = xmp.primary(987654321).split("987654321")
    return F.concat(F.lit(before), gain_bytes.cast("string"), F.lit(after))
