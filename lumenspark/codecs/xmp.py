"""XMP packets: the primary's image directory, gain map parameters, and reading properties back."""

from __future__ import annotations

import re
import struct

from .container import GainMeta

# Namespaces, packet marks, pixel format codes and the version of the vendor block.
NS = {
    "x": "adobe:ns:meta/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "Container": "http://ns.google.com/photos/1.0/container/",
    "Item": "http://ns.google.com/photos/1.0/container/item/",
    "hdrgm": "http://ns.adobe.com/hdr-gain-map/1.0/",
    "apdi": "http://ns.apple.com/pixeldatainfo/1.0/",
    "HDRGainMap": "http://ns.apple.com/HDRGainMap/1.0/",
    "HDRToneMap": "http://ns.apple.com/HDRToneMap/1.0/",
}
PACKET_BEGIN = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>'
PACKET_END = '<?xpacket end="w"?>'
AUXILIARY = "urn:com:apple:photo:2020:aux:hdrgainmap"
FORMATS = {1: int.from_bytes(b"L008"), 3: int.from_bytes(b"444f")}
VENDOR_VERSION = 0x20000
PARAMETERS = ("GainMapMin", "GainMapMax", "Gamma", "OffsetSDR", "OffsetHDR")
VENDOR_PARAMETERS = ("GainMapMin", "GainMapMax", "Gamma", "BaseOffset", "AlternateOffset")


def number(v: float) -> str:
    """Six significant digits of the value in single precision."""
    return f"{struct.unpack('f', struct.pack('f', v))[0]:.6g}"


def _open(name: str, spaces: tuple[str, ...] = (), **attributes: str) -> str:
    declared = "".join(f' xmlns:{s}="{NS[s]}"' for s in spaces)
    return f"<{name}" + declared + "".join(f' {k.replace("__", ":")}="{v}"' for k, v in attributes.items())


def element(name: str, body: str) -> str:
    return f"<{name}>{body}</{name}>"


def sequence(items) -> str:
    return element("rdf:Seq", "".join(items))


def packet(*descriptions: str) -> str:
    """Descriptions wrapped as a packet."""
    body = "".join(descriptions)
    return f'{PACKET_BEGIN}{_open("x:xmpmeta", ("x",))}>{_open("rdf:RDF", ("rdf",))}>{body}</rdf:RDF></x:xmpmeta>{PACKET_END}'


def _description(spaces: tuple[str, ...], attributes: dict[str, str], body: str) -> str:
    about = '<rdf:Description rdf:about=""' + "".join(f' xmlns:{s}="{NS[s]}"' for s in spaces)
    return about + "".join(f' {k}="{v}"' for k, v in attributes.items()) + f">{body}</rdf:Description>"


def primary(gain_bytes: int) -> str:
    """Directory of a primary image: itself and a gain map of so many bytes."""
    item = lambda more: f'<rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic={more}/></rdf:li>'
    listed = sequence((item('"Primary" Item:Mime="image/jpeg"'), item(f'"GainMap" Item:Mime="image/jpeg" Item:Length="{gain_bytes}"')))
    return packet(_description(("Container", "Item", "hdrgm"), {"hdrgm:Version": "1.0"}, element("Container:Directory", listed)))


def vendor_block(m: GainMeta) -> str:
    """The phone maker's description of the same map; its headroom is linear beside the one in stops."""
    rows = m.channels()
    code = str(FORMATS[len(rows)])
    channel = lambda row: '<rdf:li rdf:parseType="Resource">' + "".join(element(f"HDRToneMap:{n}", number(v)) for n, v in zip(VENDOR_PARAMETERS, row, strict=True)) + "</rdf:li>"
    parts = (
        ("apdi:AuxiliaryImageType", AUXILIARY),
        ("apdi:NativeFormat", code),
        ("apdi:StoredFormat", code),
        ("HDRGainMap:HDRGainMapVersion", str(VENDOR_VERSION)),
        ("HDRGainMap:HDRGainMapHeadroom", number(2.0**m.alt_headroom)),
        ("HDRToneMap:AlternateHeadroom", number(m.alt_headroom)),
        ("HDRToneMap:ChannelMetadata", sequence(map(channel, rows))),
        ("HDRToneMap:BaseHeadroom", number(m.base_headroom)),
        ("HDRToneMap:BaseColorIsWorkingColor", "True"),
        ("HDRToneMap:Version", "1"),
    )
    return _description(("apdi", "HDRGainMap", "HDRToneMap"), {}, "".join(element(n, v) for n, v in parts))


def gain_map(m: GainMeta) -> str:
    """Parameters of a gain map: an attribute where channels agree, a sequence of three where they do not."""
    attributes = {"hdrgm:Version": "1.0", "hdrgm:HDRCapacityMin": number(m.base_headroom), "hdrgm:HDRCapacityMax": number(m.alt_headroom), "hdrgm:BaseRenditionIsHDR": "False"}
    body = ""
    for name, values in zip(PARAMETERS, (m.lo, m.hi, m.gamma, m.base_offset, m.alt_offset), strict=True):
        if m.multi and len(set(values)) > 1:
            body += element(f"hdrgm:{name}", sequence(element("rdf:li", number(v)) for v in values))
        else:
            attributes[f"hdrgm:{name}"] = number(values[0])
    return packet(_description(("hdrgm",), attributes, body), *([vendor_block(m)] if m.apple else []))


def merged(xml: str, block: str) -> str:
    """A packet with one more description."""
    return xml.replace("</rdf:RDF>", block + "</rdf:RDF>")


def property_form(name: str, xml: str) -> tuple[str | None, str | None]:
    """Text of a property and how it is written (attribute or seq); items of a sequence are joined by ', '."""
    own = re.escape(name)
    if (m := re.search(own + r'\s*=\s*"([^"]*)"', xml)) is not None:
        return m[1], "attribute"
    if (m := re.search(f"<{own}>(.*?)</{own}>", xml, re.DOTALL)) is None:
        return None, None
    items = re.findall(r"<rdf:li[^>]*>([^<]*)</rdf:li>", m[1])
    return ", ".join(i.strip() for i in items) if items else m[1].strip(), "seq"
