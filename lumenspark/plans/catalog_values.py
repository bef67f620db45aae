"""Queries of value-level operators: options, spaces, names, numbers in bytes, metadata text, settings, tags and blocks of samples."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from ..codecs import container, exif, icc, jpeg, xmp
from ..functions import binary, color, metadata, tone
from ..functions.bind import bound
from ..operators import blocks, settings, stats, tags
from ..sources import patterns
from ..sources.files import mapped
from . import options
from .registry import dealt, query, read
from .registry import rounded as _r

_SPACES = list(color.PRIMARIES)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


def _pick(values, c):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


# spaces and rules per image ---------------------------------------------------------------------
@query("WITH s AS (SELECT event_type, CASE WHEN value / 100 > 1 THEN log2(value / 100) ELSE 0 END AS m FROM events) SELECT event_type, round(avg(CASE WHEN least(2.0, m) <= 0 THEN 1e-4 ELSE least(2.0, m) END), 6) AS auto, round(avg(2.0), 6) AS fixed FROM s GROUP BY event_type")
def max_boost(spark, d):
    m = tone.headroom(F.col("value") / 100)
    return read(spark, d, "events").groupBy("event_type").agg(_r(F.avg(tone.max_boost(2.0, m))).alias("auto"), _r(F.avg(tone.max_boost(2.0, m, auto=False))).alias("fixed"))


_OPTION = ["auto", "srgb", "p3"]
_CODED = ["auto", "auto", "pq"]


@query(
    f"WITH q AS (SELECT {_list(_OPTION)}[l_linenumber % 3 + 1] AS op, {_list(_CODED)}[l_quantity::BIGINT % 3 + 1] AS ot, l_suppkey % 2 = 0 AS fl, CASE WHEN l_returnflag = 'N' THEN NULL ELSE {_list(_SPACES)}[l_partkey % 5 + 1] END AS pp, CASE WHEN l_linestatus = 'F' THEN NULL WHEN l_partkey % 2 = 0 THEN 'gamma18' ELSE 'srgb' END AS pt FROM lineitem), "
    "r AS (SELECT *, CASE WHEN op <> 'auto' THEN op WHEN pp IS NOT NULL THEN pp ELSE 'prophoto' END AS primaries FROM q) "
    "SELECT primaries, CASE WHEN ot <> 'auto' THEN ot WHEN fl THEN 'linear' WHEN pt IS NULL THEN CASE WHEN primaries = 'prophoto' THEN 'romm' ELSE 'srgb' END WHEN primaries = 'prophoto' AND pt = 'gamma18' THEN 'romm' ELSE pt END AS transfer, count(*) AS n FROM r GROUP BY ALL"
)
def resolve_space(spark, d):
    li = read(spark, d, "lineitem")
    q = li.select(
        _pick(_OPTION, F.col("l_linenumber") % 3).alias("op"), _pick(_CODED, F.col("l_quantity").cast("long") % 3).alias("ot"), (F.col("l_suppkey") % 2 == 0).alias("fl"),
        F.when(F.col("l_returnflag") != "N", _pick(_SPACES, F.col("l_partkey") % 5)).alias("pp"), F.when(F.col("l_linestatus") != "F", F.when(F.col("l_partkey") % 2 == 0, "gamma18").otherwise("srgb")).alias("pt"),
    )
    q = q.withColumn("primaries", color.resolve_primaries(F.col("op"), F.col("pp")))
    return q.groupBy("primaries", color.resolve_transfer(F.col("ot"), F.col("fl"), F.col("primaries"), F.col("pt")).alias("transfer")).agg(F.count("*").alias("n"))


@query(f"SELECT n_nationkey, {_list(_SPACES)}[n_nationkey // 5 + 1] = {_list(_SPACES)}[n_nationkey % 5 + 1] AS identity FROM nation")
def identity_pairs(spark, d):
    same = [color.is_identity(color.conversion(a, b)) for a in _SPACES for b in _SPACES]
    return read(spark, d, "nation").select("n_nationkey", _pick(same, F.col("n_nationkey")).alias("identity"))


_MIXED = {n: [color.conversion(n, "p3")[i].tolist() for i in range(3)] for n in _SPACES}
_RAW = ("l_extendedprice / 110000", "l_quantity / 50", "l_tax * 12.5")


def _light_sql(t: str, v: str) -> str:
    return {"srgb": f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END", "gamma22": f"CASE WHEN {v} <= 0 THEN 0 ELSE pow({v}, 2.2) END", "linear": v}[t]


def _mixed_sql(i: int) -> str:
    made = " ".join(f"WHEN space = '{n}' THEN " + " + ".join(f"({w!r}) * {c}" for w, c in zip(rows[i], "rgb", strict=True)) for n, rows in _MIXED.items())
    return f"CASE {made} END"


@query(
    f"WITH q AS (SELECT {_list(_SPACES)}[l_suppkey % 5 + 1] AS space, {_list(['srgb', 'gamma22', 'linear'])}[l_partkey % 3 + 1] AS t, {', '.join(f'{x} AS {c}' for x, c in zip(_RAW, 'rgb', strict=True))} FROM lineitem), "
    f"l AS (SELECT space, {', '.join('CASE ' + ' '.join(f'WHEN t = {chr(39)}{t}{chr(39)} THEN {_light_sql(t, c)}' for t in ('srgb', 'gamma22', 'linear')) + f' END AS {c}' for c in 'rgb')} FROM q) SELECT space, {', '.join(f'round(avg({_mixed_sql(i)}), 6) AS {c}' for i, c in enumerate('rgb'))} FROM l GROUP BY space"
)
def mixed_spaces(spark, d):
    """Images of different spaces and curves brought to one working space in one pass."""
    li = read(spark, d, "lineitem").select(_pick(_SPACES, F.col("l_suppkey") % 5).alias("space"), _pick(["srgb", "gamma22", "linear"], F.col("l_partkey") % 3).alias("t"), (F.col("l_extendedprice") / 110000).alias("r"), (F.col("l_quantity") / 50).alias("g"), (F.col("l_tax") * 12.5).alias("b"))
    lin = li.select("space", *[color.decode_by(F.col("t"), F.col(c)).alias(c) for c in "rgb"])
    out = color.convert_by(F.col("space"), "p3", *[F.col(c) for c in "rgb"])
    return lin.groupBy("space").agg(*[_r(F.avg(v)).alias(c) for c, v in zip("rgb", out, strict=True)])


@query("SELECT p_partkey, CAST(greatest(ceil(e / 2048.0), CASE WHEN e > 512 THEN 2 ELSE 1 END) AS INTEGER) AS block, CAST(g AS INTEGER) AS guide, CAST(greatest(2, floor(ceil(e / g) / 16)) AS INTEGER) AS radius FROM (SELECT p_partkey, e, greatest(1, ceil(e / 1024.0)) AS g FROM (SELECT p_partkey, greatest(p_size * 190, p_partkey % 4000 + 1) AS e FROM part))")
def image_geometry(spark, d):
    w, h = F.col("p_size") * 190, F.col("p_partkey") % 4000 + 1
    g = stats.guide_block_of(w, h)
    return read(spark, d, "part").select("p_partkey", stats.block_size_of(w, h).alias("block"), g.alias("guide"), stats.guide_radius_of(F.ceil(w / g), F.ceil(h / g)).alias("radius"))


_P3W = color.weights("p3")


@query(f"WITH s AS (SELECT event_type, value / 100 - 0.3 AS l FROM events), m AS (SELECT event_type, max(l) AS top FROM s GROUP BY 1) SELECT event_type, round(avg(l * {sum(_P3W)!r}), 6) AS luminance, round(avg(least(top * 0.5, greatest(0, l))), 6) AS held FROM s JOIN m USING (event_type) GROUP BY event_type")
def grey_held(spark, d):
    """A grey image replicated to three channels, its luminance, and channels held between 0 and their ceilings."""
    s = read(spark, d, "events").select(F.col("event_type").alias("image_id"), (F.col("value") / 100 - 0.3).alias("r"), F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("b"))
    from ..sources.tiff import grey_to_rgb

    rgb = grey_to_rgb(s)
    lum = rgb.groupBy("image_id").agg(_r(F.avg(color.dot(_P3W, F.col("r"), F.col("g"), F.col("b")))).alias("luminance"))
    top = rgb.groupBy("image_id").agg(*[(F.max(c) * 0.5).alias(f"ceil_{c}") for c in "rgb"])
    held = stats.held(rgb, top).groupBy("image_id").agg(_r(F.avg("g")).alias("held"))
    return lum.join(held, "image_id").withColumnRenamed("image_id", "event_type")


def _coded_sql(v: str) -> str:
    c = f"least(1.0, greatest(0.0, {v}))"
    return f"round(255 * CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END)"


@query(f"WITH q AS (SELECT l_returnflag AS image_id, {_coded_sql('l_extendedprice / 50000 * 0.7')} AS r, {_coded_sql('l_quantity / 25 * 0.7')} AS g, {_coded_sql('l_tax * 12.5 * 1.6')} AS b FROM lineitem) SELECT image_id, CAST(sum(CASE WHEN r = 255 AND g = 255 AND b = 255 THEN 1 ELSE 0 END) AS BIGINT) AS flat_white, round(avg(r + g + b) / 765, 6) AS mean_level FROM q GROUP BY 1")
def sdr_pixels(spark, d):
    """SDR pixels as they are written: scaled, clamped, coded and rounded; flat white and the mean level over them."""
    li = read(spark, d, "lineitem")
    px = li.select(F.col("l_returnflag").alias("image_id"), tone.sdr_pixel(F.col("l_extendedprice") / 50000, F.lit(0.7)).alias("r"), tone.sdr_pixel(F.col("l_quantity") / 25, F.lit(0.7)).alias("g"), tone.sdr_pixel(F.col("l_tax") * 12.5, F.lit(1.6)).alias("b"))
    return stats.flat_white(px).withColumn("mean_level", _r(F.col("mean_level")))


@query(f"WITH q AS (SELECT l_returnflag AS flag, {', '.join(f'log2(({x} + 0.015625) / (least(1.0, greatest(0.0, {x} * 0.4)) + 0.015625)) AS {c}' for x, c in zip(('l_extendedprice / 50000', 'l_quantity / 25', 'l_tax * 12.5'), 'rgb', strict=True))} FROM lineitem) SELECT flag, {', '.join(f'round(avg({c}), 6) AS {c}' for c in 'rgb')} FROM q GROUP BY flag")
def channel_gains(spark, d):
    """Gains of each channel by itself."""
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 50000).alias("r"), (F.col("l_quantity") / 25).alias("g"), (F.col("l_tax") * 12.5).alias("b"))
    return li.groupBy("flag").agg(*[_r(F.avg(tone.gain(F.col(c), color.clamp(F.col(c) * 0.4, 0, 1)))).alias(c) for c in "rgb"])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(abs(l_extendedprice - 30000)), 4) AS mae, count(*) AS n FROM lineitem")
def study_statistics(spark, d):
    return stats.study(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 30000.0).select(_r(F.col("r")).alias("r"), _r(F.col("mae"), 4).alias("mae"), "n")


@query("SELECT event_type, round(avg(abs(log2((value / 100 + 0.1) / (user_id % 7 + 1)))), 6) AS ev, round(max(abs(log2((value / 100 + 0.1) / (user_id % 7 + 1)))), 6) AS worst FROM events GROUP BY 1")
def ev_drift(spark, d):
    e = tone.ev(F.col("value") / 100 + 0.1, F.col("user_id") % 7 + F.lit(1.0))
    return read(spark, d, "events").groupBy("event_type").agg(_r(F.avg(e)).alias("ev"), _r(F.max(e)).alias("worst"))


# options ----------------------------------------------------------------------------------------
_ARGS = [
    ["--input", "a", "--output", "b"], ["--input", "a"], ["--input", "a", "--output", "b", "--quality", "101"], ["--input", "a", "--output", "b", "--subsample", "3"], ["--input", "a", "--output", "b", "--headroom", "x"],
    ["--input", "a", "--output", "b", "--color-space", "ProPhotoRGB"], ["--input", "a", "--output", "b", "--tone-map", "none", "--sdr-lift", "1", "--auto-shape"], ["-i", "a", "-o", "b", "-q", "75", "--channels", "mono"], ["--unknown"], ["--input", "a", "--output"],
]
_PARSED = [(True, "p3", "local", "auto", 90, True), None, None, None, None, None, (True, "p3", "clip", "auto", 90, True), (True, "p3", "local", "auto", 75, False), None, None]


def _parsed_rows(key, which) -> Iterator[tuple]:
    try:
        o = options.parse(_ARGS[which])
    except options.OptionError:
        yield key, False, None, None, None, None, None
        return
    yield key, True, o.color_space, o.tone_map, o.shape, o.quality, o.multi


_PARSED_SQL = ", ".join(f"({i}, " + (", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (p or (False,) + (None,) * 5))) + ")" for i, p in enumerate(_PARSED))


@query(f"WITH e(i, ok, color_space, tone_map, shape, quality, multi) AS (VALUES {_PARSED_SQL}) SELECT c_custkey, ok, color_space, tone_map, shape, quality, multi FROM customer JOIN e ON e.i = c_custkey % {len(_ARGS)}")
def parsed_options(spark, d):
    c = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % len(_ARGS)).cast("int").alias("which"))
    return mapped(c, _parsed_rows, "c_custkey long, ok boolean, color_space string, tone_map string, shape string, quality int, multi boolean")


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'sRGB' WHEN 1 THEN 'DisplayP3' WHEN 2 THEN 'Rec2020' WHEN 3 THEN 'ProPhotoRGB' WHEN 4 THEN 'AdobeRGB' ELSE 'auto' END AS space, CASE n_nationkey % 4 WHEN 0 THEN 'gamma1.8' WHEN 1 THEN 'romm' WHEN 2 THEN 'pq' ELSE 'hlg' END AS transfer FROM nation")
def space_names(spark, d):
    """Spellings of the option interface to the names that reports give."""
    spelt, curves = ["rec709", "displayp3", "bt2020", "romm", "adobergb", "auto"], ["gamma18", "prophoto", "rec2100pq", "rec2100hlg"]
    n = read(spark, d, "nation").select("n_nationkey", _pick(spelt, F.col("n_nationkey") % 6).alias("s"), _pick(curves, F.col("n_nationkey") % 4).alias("t"))
    return n.select("n_nationkey", color.named(color.named(F.col("s"), color.ALIASES), color.PRIMARIES_NAMES).alias("space"), color.named(color.named(F.col("t"), color.TRANSFERS), color.TRANSFER_NAMES).alias("transfer"))


# numbers and metadata in bytes ------------------------------------------------------------------
@query("SELECT p_partkey, printf('%02X', p_size) || printf('%04X', p_partkey % 65536) || printf('%08X', p_partkey * 70000 % 4294967296) AS be, upper(regexp_replace(printf('%08X', p_partkey * 70000 % 4294967296), '(..)(..)(..)(..)', '\\4\\3\\2\\1')) AS le, printf('%08X', CASE WHEN p_partkey = 0 THEN 0 ELSE 4294967296 - p_partkey END) AS negative, p_partkey * 70000 % 4294967296 AS back, -p_partkey AS signed FROM part")
def binary_words(spark, d):
    k, wide = F.col("p_partkey"), F.pmod(F.col("p_partkey") * 70000, F.lit(1 << 32))
    p = read(spark, d, "part").select("p_partkey", F.concat(binary.u8(F.col("p_size")), binary.u16(F.pmod(k, F.lit(65536))), binary.u32(wide)).alias("b"), binary.u32(wide, little=True).alias("l"), binary.u32(-k).alias("s"))
    return p.select("p_partkey", F.hex("b").alias("be"), F.hex("l").alias("le"), F.hex("s").alias("negative"), binary.read(F.col("l"), 0, 4, True).alias("back"), binary.read_signed(F.col("s"), 0, 4).alias("signed"))


@query("SELECT p_partkey, printf('%.6g', CAST(CAST(p_retailprice / 7 AS FLOAT) AS DOUBLE)) AS a, printf('%.6g', CAST(CAST(p_retailprice * 1000 AS FLOAT) AS DOUBLE)) AS b, printf('%.6g', CAST(CAST(p_size / 9e6 AS FLOAT) AS DOUBLE)) AS c FROM part")
def significant_digits(spark, d):
    return read(spark, d, "part").select("p_partkey", *[metadata.significant(v).alias(n) for n, v in (("a", F.col("p_retailprice") / 7), ("b", F.col("p_retailprice") * 1000), ("c", F.col("p_size") / 9e6))])


_S = "CAST(round(least(2147483647, greatest(-2147483648, {} * 1000000))) AS BIGINT)"
_U = "CAST(round(least(4294967295, greatest(0, {} * 1000000))) AS BIGINT)"


def _hex32(v: str) -> str:
    return f"printf('%08X', CASE WHEN {v} < 0 THEN {v} + 4294967296 ELSE {v} END)"


@query(f"WITH q AS (SELECT s_suppkey, s_acctbal / 3 AS v FROM supplier) SELECT s_suppkey, {_hex32(_S.format('v'))} || '000F4240' AS signed, {_hex32(_U.format('v'))} || '000F4240' AS unsigned, {_hex32('CAST(round(v / 50 * 65536) AS BIGINT)')} AS fixed FROM q")
def rationals(spark, d):
    v = F.col("s_acctbal") / 3
    return read(spark, d, "supplier").select("s_suppkey", F.hex(binary.srational(v)).alias("signed"), F.hex(binary.rational(v)).alias("unsigned"), F.hex(binary.s15fixed16(v / 50)).alias("fixed"))


def _gain_rows(spark, d):
    """Gain map parameters of each part: three channels that agree in every third."""
    same, k = F.col("p_partkey") % 3 == 0, F.col("p_partkey")
    arr = lambda a, step: F.array(*[(a + F.when(same, 0.0).otherwise(i * step)).cast("double") for i in range(3)])
    return read(spark, d, "part").select(
        "p_partkey", (k % 2 == 0).alias("multi"), (k % 5 != 0).alias("use_base"), (F.col("p_size") / 1000).alias("base_headroom"), (F.col("p_size") / 8.0).alias("alt_headroom"),
        arr(-F.col("p_size") / 64.0, 0.25).alias("lo"), arr(F.col("p_size") / 16.0, 0.125).alias("hi"), arr(F.lit(1.0), 0.0).alias("gamma"), arr(F.lit(1 / 64), 0.0).alias("base_offset"), arr(F.lit(1 / 64), 0.5).alias("alt_offset"),
    )


_GAIN = "g AS (SELECT p_partkey, p_partkey % 2 = 0 AS multi, p_partkey % 5 <> 0 AS use_base, p_size / 1000 AS bh, p_size / 8.0 AS ah, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS k, p_size FROM part)"
_FIELDS = ("-p_size / 64.0 + k * {} * 0.25", "p_size / 16.0 + k * {} * 0.125", "1.0", "0.015625", "0.015625 + k * {} * 0.5")


def _channel_hex(c: int) -> str:
    return " || ".join(f"{_hex32((_U if i == 2 else _S).format('(' + f.format(c) + ')'))} || '000F4240'" for i, f in enumerate(_FIELDS))


@query(f"WITH {_GAIN} SELECT p_partkey, '{container.URN.hex().upper()}' || '00000001' || printf('%02X', CASE WHEN multi THEN 128 ELSE 0 END + CASE WHEN use_base THEN 64 ELSE 0 END) || {_hex32(_U.format('bh'))} || '000F4240' || {_hex32(_U.format('ah'))} || '000F4240' || {_channel_hex(0)} || CASE WHEN multi THEN {_channel_hex(1)} || {_channel_hex(2)} ELSE '' END AS payload FROM g")
def gain_payload(spark, d):
    g = _gain_rows(spark, d)
    return g.select("p_partkey", F.hex(metadata.payload(*[F.col(c) for c in g.columns[1:]])).alias("payload"))


@query(f"WITH {_GAIN} SELECT p_partkey, multi, use_base, 1 AS writer_version, round(ah, 6) AS alt_headroom, CASE WHEN multi THEN 3 ELSE 1 END AS channels, round(-p_size / 64.0 + CASE WHEN multi THEN k * 2 * 0.25 ELSE 0 END, 6) AS lo, CAST(round(0.015625 + CASE WHEN multi THEN k ELSE 0 END, 6) AS DOUBLE) AS alt_offset FROM g")
def gain_payload_parsed(spark, d):
    """Payloads put into segments and read back."""
    from ..sources import jpeg as source

    g = _gain_rows(spark, d)
    s = g.select(F.col("p_partkey").alias("path"), F.lit(1).alias("image_no"), F.lit(0).alias("seq"), F.lit(0xE2).alias("marker"), metadata.payload(*[F.col(c) for c in g.columns[1:]]).alias("payload")).withColumn("size", F.length("payload"))
    last = F.element_at("channels", -1)
    return source.payloads(s).select(F.col("path").alias("p_partkey"), "multi", "use_base", F.col("writer_version").cast("int").alias("writer_version"), _r(F.col("alt_headroom")).alias("alt_headroom"), F.size("channels").alias("channels"), _r(last["lo"]).alias("lo"), _r(last["alt_offset"]).alias("alt_offset"))


def _number_sql(v: str) -> str:
    return f"printf('%.6g', CAST(CAST({v} AS FLOAT) AS DOUBLE))"


def _xmp_sql() -> tuple[str, str]:
    spaces = f'xmlns:x="{xmp.NS["x"]}"', f'xmlns:rdf="{xmp.NS["rdf"]}"', f'xmlns:hdrgm="{xmp.NS["hdrgm"]}"'
    head = f"'{xmp.PACKET_BEGIN}<x:xmpmeta {spaces[0]}><rdf:RDF {spaces[1]}><rdf:Description rdf:about=\"\" {spaces[2]} hdrgm:Version=\"1.0\" hdrgm:HDRCapacityMin=\"' || {_number_sql('bh')} || '\" hdrgm:HDRCapacityMax=\"' || {_number_sql('ah')} || '\" hdrgm:BaseRenditionIsHDR=\"False\"'"
    attributes, elements = "", ""
    for name, f in zip(xmp.PARAMETERS, _FIELDS, strict=True):
        one, varies = _number_sql(f.format(0)), "{}" in f
        plain = f"' hdrgm:{name}=\"' || {one} || '\"'"
        attributes += f" || CASE WHEN multi AND k > 0 AND {varies} THEN '' ELSE {plain} END"
        items = " || ".join(f"'<rdf:li>' || {_number_sql(f.format(c))} || '</rdf:li>'" for c in range(3))
        elements += f" || CASE WHEN multi AND k > 0 AND {varies} THEN '<hdrgm:{name}><rdf:Seq>' || {items} || '</rdf:Seq></hdrgm:{name}>' ELSE '' END"
    vendor = "".join(f"<HDRToneMap:{n}>' || {_number_sql(f.format('0'))} || '</HDRToneMap:{n}>" for n, f in zip(xmp.VENDOR_PARAMETERS, _FIELDS, strict=True))
    code = xmp.FORMATS[1]
    block = (
        f"'<rdf:Description rdf:about=\"\" xmlns:apdi=\"{xmp.NS['apdi']}\" xmlns:HDRGainMap=\"{xmp.NS['HDRGainMap']}\" xmlns:HDRToneMap=\"{xmp.NS['HDRToneMap']}\"><apdi:AuxiliaryImageType>{xmp.AUXILIARY}</apdi:AuxiliaryImageType><apdi:NativeFormat>{code}</apdi:NativeFormat><apdi:StoredFormat>{code}</apdi:StoredFormat>"
        f"<HDRGainMap:HDRGainMapVersion>131072</HDRGainMap:HDRGainMapVersion><HDRGainMap:HDRGainMapHeadroom>' || {_number_sql('pow(2, ah)')} || '</HDRGainMap:HDRGainMapHeadroom><HDRToneMap:AlternateHeadroom>' || {_number_sql('ah')} || '</HDRToneMap:AlternateHeadroom><HDRToneMap:ChannelMetadata><rdf:Seq><rdf:li rdf:parseType=\"Resource\">{vendor}</rdf:li></rdf:Seq></HDRToneMap:ChannelMetadata>"
        f"<HDRToneMap:BaseHeadroom>' || {_number_sql('bh')} || '</HDRToneMap:BaseHeadroom><HDRToneMap:BaseColorIsWorkingColor>True</HDRToneMap:BaseColorIsWorkingColor><HDRToneMap:Version>1</HDRToneMap:Version></rdf:Description>'"
    )
    return f"{head}{attributes} || '>'{elements} || '</rdf:Description>'", block


_XMP, _BLOCK = _xmp_sql()
_XMP_END = f"'</rdf:RDF></x:xmpmeta>{xmp.PACKET_END}'"
_META = "multi boolean, use_base boolean, base_headroom double, alt_headroom double, lo array<double>, hi array<double>, gamma array<double>, base_offset array<double>, alt_offset array<double>"


def _packets(key, multi, use_base, base, alt, *rows) -> Iterator[tuple]:
    m = container.GainMeta(multi, use_base, False, base, alt, *map(tuple, rows))
    one = container.GainMeta(False, use_base, True, base, alt, *map(tuple, rows))
    yield key, xmp.gain_map(m), xmp.vendor_block(one)


def _xmp_rows(spark, d):
    return mapped(_gain_rows(spark, d), _packets, "p_partkey long, xml string, block string")


@query(f"WITH {_GAIN} SELECT p_partkey, md5({_XMP} || {_XMP_END}) AS packet, md5({_XMP} || {_BLOCK} || {_XMP_END}) AS merged FROM g")
def gain_xmp(spark, d):
    """Parameters as a packet, and the packet with the phone maker's description merged into it."""
    x = _xmp_rows(spark, d)
    return x.select("p_partkey", F.md5(F.encode("xml", "UTF-8")).alias("packet"), F.md5(F.encode(metadata.merged(F.col("xml"), F.col("block")), "UTF-8")).alias("merged"))


_SEQ = "CASE WHEN multi AND k > 0 THEN "


@query(f"WITH {_GAIN} SELECT p_partkey, {_SEQ}{' || {} || '.format(chr(39) + ', ' + chr(39)).join(_number_sql(_FIELDS[1].format(c)) for c in range(3))} ELSE {_number_sql(_FIELDS[1].format(0))} END AS value, {_SEQ}'seq' ELSE 'attribute' END AS form, {_number_sql('ah')} AS capacity, CAST(NULL AS VARCHAR) AS missing FROM g")
def xmp_properties(spark, d):
    own = metadata.property_form("hdrgm:GainMapMax", F.col("xml"))
    return _xmp_rows(spark, d).select("p_partkey", own["value"].alias("value"), own["form"].alias("form"), metadata.property_value("hdrgm:HDRCapacityMax", F.col("xml")).alias("capacity"), metadata.property_value("hdrgm:Nothing", F.col("xml")).alias("missing"))


_PRIMARY = xmp.primary(7654321).split("7654321")


@query(f"SELECT p_partkey, md5('{_PRIMARY[0]}' || (p_partkey * 11) || '{_PRIMARY[1]}') AS packet, '{container.base_marker().hex().upper()}' AS marker, '{container.jfif(True).hex().upper()}' AS jfif, 'FFE1' || printf('%04X', 29 + 2 + length(p_name)) || '{container.XMP_ID.hex().upper()}' || hex(p_name) AS segment, CAST(ceil(p_size * 5000 / 65519.0) AS INTEGER) AS chunks, CAST(p_size * 5000 + 18 * ceil(p_size * 5000 / 65519.0) AS BIGINT) AS bytes FROM part")
def app_segments(spark, d):
    """Segments of a base image: directory packet, marker, JFIF, an XMP segment, and a colour profile in chunks."""
    chunks = metadata.icc_chunks(F.repeat(F.lit("p"), F.col("p_size") * 5000).cast("binary"))
    told = bound(chunks, lambda c: F.struct(F.size(c).alias("chunks"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("bytes")))
    body = F.concat(binary.raw(container.XMP_ID), binary.text(F.col("p_name")))
    return dealt(read(spark, d, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.md5(F.encode(metadata.primary_packet(F.col("p_partkey") * 11), "UTF-8")).alias("packet"), F.hex(binary.raw(container.base_marker())).alias("marker"), F.hex(binary.raw(container.jfif(True))).alias("jfif"), F.hex(metadata.segment(0xE1, body)).alias("segment"), told.alias("told")).select("*", "told.*").drop("told")


_PROFILES = [*icc.CANDIDATES]


def _profile_rows(key, space, gamma) -> Iterator[tuple]:
    a, b = icc.inspect(icc.rgb_profile(space)), icc.inspect(icc.grey_profile(gamma, "grey"))
    broken = icc.inspect(icc.rgb_profile(space)[:100])
    yield key, a.primaries, a.transfer, a.description, b.grey, b.transfer, broken.valid


@query(f"SELECT n_nationkey, {_list(_PROFILES)}[n_nationkey % 5 + 1] AS primaries, 'srgb' AS transfer, CASE n_nationkey % 5 WHEN 2 THEN 'Display P3' WHEN 1 THEN 'Rec. ITU-R BT.2020' ELSE 'sRGB IEC61966-2.1' END AS description, true AS grey, CASE n_nationkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'gamma18' ELSE 'gamma22' END AS curve, false AS broken FROM nation")
def colour_profiles(spark, d):
    """Profiles built and read back, grey ones and damaged ones among them."""
    n = read(spark, d, "nation").select("n_nationkey", _pick(_PROFILES, F.col("n_nationkey") % 5).alias("s"), _pick([1.0, 1.8, 2.2], F.col("n_nationkey") % 3).alias("g"))
    return mapped(n.withColumn("n_nationkey", F.col("n_nationkey").cast("int")), _profile_rows, "n_nationkey int, primaries string, transfer string, description string, grey boolean, curve string, broken boolean")


@query("WITH q AS (SELECT event_id, least(1.0, value / 490) AS v, 0.5005 AS x FROM events), e AS (SELECT event_id, abs(v - x) AS a, abs(v - pow(x, 1.8)) AS b, abs(v - pow(x, 2.2)) AS c, abs(v - pow((x + 0.055) / 1.055, 2.4)) AS d FROM q) SELECT CASE WHEN a <= least(b, c, d) THEN 'linear' WHEN b <= least(c, d) THEN 'gamma18' WHEN c <= d THEN 'gamma22' ELSE 'srgb' END AS curve, count(*) AS n FROM e GROUP BY 1")
def nearest_curve(spark, d):
    """The transfer curve nearest to a curve's middle; the first listed wins ties."""
    v, x = F.least(F.lit(1.0), F.col("value") / 490), 0.5005
    return read(spark, d, "events").groupBy(color.nearest_transfer(F.lit(x), v).alias("curve")).agg(F.count("*").alias("n"))


# tags -------------------------------------------------------------------------------------------
def _tag_rows(spark, d):
    """Fields of each supplier's image: kept and dropped ones, a field without a value, one that is too long."""
    s = F.col("s_suppkey")
    row = lambda i, t, k, v: F.struct(F.lit(i).alias("ifd"), F.lit(t).alias("tag"), F.lit(k).alias("type"), F.length(v).cast("long").alias("count"), v.alias("value"))
    long_ = F.encode(F.repeat(F.lit("m"), F.when(s % 2 == 0, 70_000).otherwise(9)), "UTF-8")
    rows = F.array(
        row("ifd0", 271, 2, binary.text(F.col("s_name"))), row("ifd0", 256, 4, binary.u32(5)), row("ifd0", 274, 3, binary.u16(6)), row("ifd0", 315, 2, long_), row("ifd0", 305, 99, F.lit(None).cast("binary")),
        row("exif", 37500, 7, binary.raw(b"maker")), row("exif", 33434, 5, binary.rational(0.01)), row("exif", 36864, 7, binary.raw(b"0230")), row("gps", 1, 2, binary.raw(b"N\x00")),
    )
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.explode(rows).alias("t")).select("path", "t.*")


_TAGS_SQL = (
    "t AS (SELECT s_suppkey AS path, 'ifd0' AS ifd, 271 AS tag, length(s_name) AS size FROM supplier UNION ALL SELECT s_suppkey, 'ifd0', 274, 2 FROM supplier UNION ALL SELECT s_suppkey, 'ifd0', 315, 9 FROM supplier WHERE s_suppkey % 2 = 1 "
    "UNION ALL SELECT s_suppkey, v.ifd, v.tag, v.size FROM supplier, (VALUES ('ifd0', 282, 8), ('ifd0', 283, 8), ('ifd0', 296, 2), ('ifd0', 531, 2), ('exif', 33434, 8), ('exif', 36864, 4), ('exif', 37121, 4), ('exif', 40960, 4), ('exif', 40961, 2), ('exif', 40962, 4), ('exif', 40963, 4), ('gps', 1, 2)) v(ifd, tag, size))"
)


@query(f"WITH {_TAGS_SQL}, o AS (SELECT *, CASE WHEN size > 4 THEN size + size % 2 ELSE 0 END AS padded FROM t) SELECT a.path, a.ifd, a.tag, CAST(a.size AS INTEGER) AS size, (SELECT count(*) FROM t b WHERE b.path = a.path AND b.ifd = a.ifd AND b.tag < a.tag) AS entry, CAST(CASE WHEN a.size > 4 THEN coalesce((SELECT sum(padded) FROM o b WHERE b.path = a.path AND b.ifd = a.ifd AND b.tag < a.tag), 0) END AS BIGINT) AS place FROM o a")
def exif_fields(spark, d):
    """Which fields an image carries, which it is given, and where their values come to lie."""
    t = _tag_rows(spark, d)
    sizes = t.select("path").distinct().select("path", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(True).alias("srgb"))
    out = tags.laid_out(tags.completed(tags.carried(t), sizes))
    return out.select("path", "ifd", "tag", F.length("value").alias("size"), F.col("entry").cast("long").alias("entry"), F.col("place").cast("long").alias("place"))


def _exif_read(path, payload) -> Iterator[tuple]:
    data = payload[6:]
    found = {t: v for t, _, _, v in exif.directory(data, 8, False)}
    own = {t: v for t, _, _, v in exif.directory(data, int.from_bytes(found[exif.EXIF_POINTER]), False)}
    far = exif.directory(data, int.from_bytes(found[exif.GPS_POINTER]), False)
    yield path, found[271].decode(), int.from_bytes(found[exif.ORIENTATION]), int.from_bytes(own[exif.WIDTH]), own[36864].decode(), len(found), len(own), len(far)


@query("SELECT s_suppkey AS path, s_name AS make, 1 AS orientation, 640 AS width, '0230' AS version, CAST(8 + s_suppkey % 2 AS INTEGER) AS ifd0, 7 AS exif, 1 AS gps FROM supplier")
def exif_payloads(spark, d):
    """The Exif segments of all images, written and read back."""
    t = _tag_rows(spark, d)
    sizes = t.select("path").distinct().select("path", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(True).alias("srgb"))
    made = tags.payloads(tags.completed(tags.carried(t), sizes).withColumn("path", F.col("path").cast("string")))
    return mapped(made.select(F.col("path").cast("long").alias("path"), "payload"), _exif_read, "path long, make string, orientation int, width int, version string, ifd0 int, exif int, gps int")


# settings and text ------------------------------------------------------------------------------
def _presets(spark, d):
    """A preset of each customer, of old and new generations, some with odd values."""
    k = F.col("c_custkey")
    maybe = lambda c, v: F.when(c, F.lit(v) if isinstance(v, str) else v)
    pairs = [
        ("iso_target_headroom", F.when(k % 4 == 0, "4.0").when(k % 4 == 1, "match").when(k % 4 == 2, "12")), ("iso_settings_version", maybe(k % 3 == 0, "6")), ("iso_gainmap_channels", maybe(k % 5 == 0, "Monochrome")),
        ("iso_gainmap_gamma", maybe(k % 7 == 0, "2.2")), ("iso_jpeg_quality", F.when(k % 6 == 0, "75.9").when(k % 6 == 1, "none")), ("iso_copy_metadata", maybe(k % 8 == 0, "false")), ("iso_input_transfer", F.when(k % 9 == 0, "pq").when(k % 9 == 1, "romm")),
        ("iso_pq_diffuse_white", maybe(k % 2 == 0, "100")), ("iso_sdr_detail", maybe(k % 10 == 0, "9")), ("own_setting", F.col("c_mktsegment")),
    ]
    return dealt(read(spark, d, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)]).alias("settings"))


_PRE = (
    "q AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '4.0' WHEN 1 THEN 'match' WHEN 2 THEN '12' END AS h0, c_custkey % 3 = 0 AS current, c_custkey % 5 = 0 AS chan, c_custkey % 7 = 0 AS gam, CASE c_custkey % 6 WHEN 0 THEN '75.9' WHEN 1 THEN 'none' ELSE '90' END AS q0, c_custkey % 8 = 0 AS bare, CASE c_custkey % 9 WHEN 0 THEN 'pq' WHEN 1 THEN 'romm' ELSE 'auto' END AS t, CASE WHEN c_custkey % 2 = 0 THEN '100' ELSE '203' END AS white, CASE WHEN c_custkey % 10 = 0 THEN '2.00' ELSE '1.25' END AS det FROM customer), "
    "p AS (SELECT *, NOT current AND (h0 IS NOT NULL OR chan OR gam) AS old FROM q), "
    "r AS (SELECT *, CASE WHEN h0 IS NULL OR (old AND h0 = '4.0') THEN 'match' ELSE h0 END AS h FROM p), "
    "s AS (SELECT *, CASE h WHEN 'match' THEN '10.0000' WHEN '12' THEN '10.0000' ELSE '4.0000' END AS cap, CASE q0 WHEN '75.9' THEN '75' ELSE '90' END AS qq FROM r)"
)


@query(f"WITH {_PRE} SELECT k AS c_custkey, h AS headroom, NOT old AND chan AS channels_kept, NOT old AND gam AS gamma_kept, '6' AS version, CASE WHEN h = '12' THEN 'target headroom must be between 0 and 10 stops' WHEN q0 = 'none' THEN 'quality must be between 1 and 100' END AS problem, array_to_string(list_concat(list_concat(list_concat(['--headroom', cap, '--color-space', 'DisplayP3', '--quality', qq, '--json', '--tone-map', 'local', '--sdr-detail', det, '--apple-compatible', '--subsample', '2'], CASE WHEN bare THEN ['--no-exif'] ELSE [] END), CASE WHEN t <> 'auto' THEN ['--input-transfer', t] ELSE [] END), CASE WHEN t = 'pq' THEN ['--pq-diffuse-white', white] ELSE [] END), ' ') AS arguments, CASE WHEN h = 'match' THEN 'headroom from the render' ELSE 'max +' || h || ' EV' END || ' / depth ' || det || ' / DisplayP3 / q' || qq AS summary, true AS again FROM s")
def export_settings(spark, d):
    """Presets brought up to date, checked and made into argument lists; doing it again changes nothing."""
    p = settings.presets(_presets(spark, d))
    c = F.col("completed")
    same = lambda m: F.array_sort(F.map_entries(m))
    return p.select(
        "c_custkey", c["iso_target_headroom"].alias("headroom"), F.map_contains_key(c, "iso_gainmap_channels").alias("channels_kept"), F.map_contains_key(c, "iso_gainmap_gamma").alias("gamma_kept"), c["iso_settings_version"].alias("version"),
        "problem", F.array_join("arguments", " ").alias("arguments"), "summary", (same(settings.completed(c)) == same(c)).alias("again"),
    )


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'TIFF' ELSE 'TIFF' END AS format, '16' AS depth, CASE WHEN s_suppkey % 2 = 0 THEN 'false' END AS reimport, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'format' END, CASE WHEN s_suppkey % 4 = 0 THEN 'bit depth' END, CASE WHEN s_suppkey % 5 = 0 THEN 'hdr off' END], lambda x: x IS NOT NULL), ',') AS problems FROM supplier")
def forced_settings(spark, d):
    """Render settings that an export forces, and what would have been wrong without that."""
    k = F.col("s_suppkey")
    m = F.map_filter(F.create_map(F.lit("LR_format"), F.when(k % 3 == 0, "JPEG").otherwise("TIFF"), F.lit("LR_export_bitDepth"), F.when(k % 4 == 0, "8").otherwise("16"), F.lit("LR_export_useHDR"), F.when(k % 5 == 0, "false").otherwise("true"), F.lit("LR_reimportExportedPhoto"), F.when(k % 2 == 0, "true")), lambda _, v: v.isNotNull())
    forced = settings.with_forced(m)
    return read(spark, d, "supplier").select("s_suppkey", forced["LR_format"].alias("format"), forced["LR_export_bitDepth"].alias("depth"), forced["LR_reimportExportedPhoto"].alias("reimport"), F.array_join(settings.render_problems(m), ",").alias("problems"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(sorted(settings.DEFAULTS.items()))) + ") t(position, key, value)")
def preset_fields(spark, d):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(settings.preset_fields())], "position int, key string, value string")


@query("SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)$', 1) = '' THEN url ELSE regexp_extract(url, '([^/]+)$', 1) END AS leaf, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '\\.([^./]+)$', 1) AS extension, regexp_replace(url, '\\.[^./]+$', '') || '.jpg' AS renamed, '''' || replace(url || '''x', '''', '''\\''''') || '''' AS quoted, 'a ' || url || ' b 7' AS filled, CASE WHEN page_id % 2 = 0 THEN url ELSE 'no colon' END AS error FROM pages")
def path_text(spark, d):
    """Parts of paths, shell words, message templates and error texts."""
    u = F.col("url")
    err = settings.error_text(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("tool: error:  "), u, F.lit(" \n"))).otherwise(F.lit("no colon")))
    return read(spark, d, "pages").select("page_id", settings.leaf(u).alias("leaf"), settings.parent(u).alias("parent"), settings.extension(u).alias("extension"), settings.with_extension(u, "jpg").alias("renamed"), settings.quoted(F.concat(u, F.lit("'x"))).alias("quoted"), settings.filled(F.lit("$$$/Some/Key=a ^1 b ^2"), u, F.lit("7")).alias("filled"), err.alias("error"))


@query("SELECT c_custkey, true AS ok, CAST(c_custkey * 10 AS BIGINT) AS total, c_mktsegment AS space, round(c_acctbal, 2) AS boost, CAST(NULL AS VARCHAR) AS bad FROM customer")
def flat_report(spark, d):
    """Reports written as flat JSON among other text and read back with their types; no report gives null."""
    line = F.concat(F.lit("log line\n"), F.to_json(F.struct(F.lit(True).alias("ok"), (F.col("c_custkey") * 10).alias("total"), F.col("c_mktsegment").alias("space"), F.col("c_acctbal").alias("boost"))), F.lit("\n"))
    schema = "ok boolean, total long, space string, boost double"
    r, bad = settings.report(line, schema), settings.report(F.lit("not json"), schema)
    return read(spark, d, "customer").select("c_custkey", r["ok"].alias("ok"), r["total"].alias("total"), r["space"].alias("space"), F.round(r["boost"], 2).alias("boost"), bad["space"].alias("bad"))


# patterns ---------------------------------------------------------------------------------------
_PAT = "p AS (SELECT i // 37 AS y, i % 37 AS x, (i % 37) / 36.0 AS u, (i // 37) / 20.0 AS v FROM range(777) t(i)), q AS (SELECT y, x, CASE WHEN u > 0.7 AND v > 0.7 THEN 8.0 WHEN v < 0.3 THEN 0.18 + 0.6 * u ELSE 0.18 + 0.5 * u END AS r, CASE WHEN u > 0.7 AND v > 0.7 THEN 8.0 WHEN v < 0.3 THEN 0.18 ELSE 0.18 + 0.5 * u END AS g, CASE WHEN u > 0.7 AND v > 0.7 THEN 8.0 WHEN v < 0.3 THEN 0.5 - 0.4 * u ELSE 0.18 + 0.5 * u END AS b FROM p)"
_HASH = "xor({0}, {0} >> {1})"


def _grain_sql(c: int) -> str:
    a, b, k, m = patterns.GRAIN
    v = f"CAST((CAST(x AS HUGEINT) * {a} + CAST(y AS HUGEINT) * {b} + {c} * {k}) % 4294967296 AS BIGINT)"
    w = f"CAST(CAST({_HASH.format(v, 13)} AS HUGEINT) * {m} % 4294967296 AS BIGINT)"
    return f"(({_HASH.format(w, 16)} & 65535) / 65535.0 - 0.5)"


@query(f"WITH {_PAT} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, " + ", ".join(f"round(greatest(0, {c} * (1 + 0.10 * sin(x * 0.31 + y * 0.17) * cos(x * 0.07 - y * 0.23)) + 0.03 * {c} * {_grain_sql(i)}), 6) AS d{c}" for i, c in enumerate("rgb")) + " FROM q")
def hdr_patterns(spark, d):
    """The gradient with a bright corner, and the same with texture and grain."""
    a = patterns.hdr_pattern(spark, 37, 21, 8.0).select("y", "x", *[_r(F.col(c)).alias(c) for c in "rgb"])
    b = patterns.detailed_pattern(spark, 37, 21, 8.0).select("y", "x", *[_r(F.col(c)).alias(f"d{c}") for c in "rgb"])
    return a.join(b, ["y", "x"])


@query(f"WITH RECURSIVE s(i, v) AS (SELECT 0, CAST({patterns.LCG[2]} AS BIGINT) UNION ALL SELECT i + 1, (v * {patterns.LCG[0]} + {patterns.LCG[1]}) % 4294967296 FROM s WHERE i < 1500), u AS (SELECT (i - 1) // 3 AS i, sum((v >> 8) / 16777216.0) AS u FROM s WHERE i > 0 GROUP BY 1) SELECT CAST(i AS INTEGER) AS i, round(0.18 * pow(2.0, (u - 1.5) * 2 * 1.6), 6) AS l FROM u")
def lognormal_scene(spark, d):
    return patterns.lognormal_scene(spark, 0.18, 1.6, 500, part=64).select("i", _r(F.col("l")).alias("l"))


@query("SELECT round(l, 4) AS l, count(*) AS n FROM (SELECT CASE WHEN y >= 1080 AND y < 1140 AND x >= 80 AND x < 1520 THEN 0.18 WHEN y >= 660 AND y < 980 AND x >= 80 AND x < 1505 AND (x - 80) % 205 < 193 THEN pow(2.0, (x - 80) // 205 * 0.5) WHEN y >= 90 AND y < 560 AND x >= 80 AND x < 1520 THEN 1.0 ELSE 0.05 END AS l FROM (SELECT i // 1600 AS y, i % 1600 AS x FROM range(1920000) t(i))) GROUP BY 1")
def test_card(spark, d):
    return patterns.test_card(spark).groupBy(F.round("l", 4).alias("l")).agg(F.count("*").alias("n"))


# blocks of samples ------------------------------------------------------------------------------
_SAMPLES = "SELECT vec_id AS y, CAST(p - 1 AS INTEGER) AS x, CAST(round(255 * least(1.0, greatest(0.0, CAST(embedding[p] AS DOUBLE) + 0.5))) AS INTEGER) AS r FROM embeddings, range(1, 65) t(p)"
_TOP = "(SELECT max(vec_id) FROM embeddings)"
_QUANT = "[" + ", ".join(str(int(v)) for v in jpeg.LUMA) + "]"
_ZIG = "[" + ", ".join(str(int(v)) for v in jpeg.ZIGZAG) + "]"
_COEF = (
    f"i AS ({_SAMPLES}), rows_ AS (SELECT y FROM range(CAST(ceil(({_TOP} + 1) / 8.0) * 8 AS BIGINT)) t(y)), padded AS (SELECT w.y AS y, i.x, i.r - 128 AS s FROM rows_ w JOIN i ON i.y = least(w.y, {_TOP})), "
    "basis AS (SELECT u, v, yy, xx, CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END * CASE WHEN v = 0 THEN sqrt(0.125) ELSE 0.5 END * cos((2 * yy + 1) * u * pi() / 16) * cos((2 * xx + 1) * v * pi() / 16) AS w FROM range(8) a(u), range(8) b(v), range(8) c(yy), range(8) e(xx)), "
    f"f AS (SELECT y // 8 AS by_, x // 8 AS bx, u * 8 + v AS k, round(sum(s * w), 9) AS f FROM padded JOIN basis ON yy = y % 8 AND xx = x % 8 GROUP BY ALL), q AS (SELECT by_ * 8 + bx AS block, CAST(list_position({_ZIG}, k) - 1 AS INTEGER) AS k, CAST(round_even(f / {_QUANT}[k + 1], 0) AS INTEGER) AS c FROM f)"
)


def _coefficients(spark, d):
    e = read(spark, d, "embeddings").select(F.lit("plane").alias("image_id"), F.col("vec_id").alias("y"), F.transform("embedding", lambda v: F.round(255 * color.clamp(v.cast("double") + 0.5, 0, 1)).cast("int")).alias("row"))
    return blocks.coefficients(e, 50)


@query(f"WITH {_COEF} SELECT block, CAST(sum(abs(c)) AS BIGINT) AS total, CAST(max(CASE WHEN k = 0 THEN c END) AS INTEGER) AS dc, CAST(max(CASE WHEN k = 5 THEN c END) AS INTEGER) AS ac5, CAST(sum(CASE WHEN c <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM q GROUP BY block")
def dct_coefficients(spark, d):
    c = _coefficients(spark, d)
    return c.select("block", F.aggregate("coefs", F.lit(0).cast("long"), lambda s, v: s + F.abs(v)).alias("total"), F.col("coefs")[0].alias("dc"), F.col("coefs")[5].alias("ac5"), F.size(F.filter("coefs", lambda v: v != 0)).cast("long").alias("filled"))


_DIFF = "df AS (SELECT block, c - lag(c, 1, 0) OVER (ORDER BY block) AS diff FROM q WHERE k = 0)"


@query(f"WITH {_COEF}, {_DIFF} SELECT block, diff FROM df")
def dc_differences(spark, d):
    """DC prediction through the whole scan."""
    return blocks.dc_differences(_coefficients(spark, d)).select("block", "diff")


@query(f"WITH {_COEF}, {_DIFF} SELECT CAST(CASE WHEN diff = 0 THEN 0 ELSE floor(log2(abs(diff))) + 1 END AS INTEGER) AS category, count(*) AS n FROM df GROUP BY 1")
def dc_categories(spark, d):
    return blocks.dc_differences(_coefficients(spark, d)).groupBy(blocks.category(F.col("diff")).alias("category")).agg(F.count("*").alias("n"))


@query(
    f"WITH {_COEF}, nz AS (SELECT block, k, c, k - lag(k, 1, 0) OVER (PARTITION BY block ORDER BY k) - 1 AS run FROM q WHERE k > 0 AND c <> 0), "
    "sy AS (SELECT CAST((run % 16) * 16 + floor(log2(abs(c))) + 1 AS INTEGER) AS symbol, 1 AS n FROM nz UNION ALL SELECT 240, run // 16 FROM nz UNION ALL SELECT 0, 1 FROM (SELECT block, max(CASE WHEN c <> 0 AND k > 0 THEN k ELSE 0 END) AS last FROM q GROUP BY block) WHERE last < 63) SELECT symbol, CAST(sum(n) AS BIGINT) AS n FROM sy WHERE n > 0 GROUP BY symbol"
)
def ac_symbols(spark, d):
    """Run and size symbols of all blocks, with runs of sixteen zeros and ends of blocks, counted."""
    return blocks.symbol_counts(_coefficients(spark, d))


@query(f"SELECT CAST(q AS INTEGER) AS quality, CAST(i AS INTEGER) AS i, CAST(least(255, greatest(1, ({_QUANT}[i + 1] * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100)) AS INTEGER) AS step FROM range(1, 101) a(q), range(64) b(i)")
def quantisation_steps(spark, d):
    return blocks.quantisation(spark.range(1, 101).select(F.col("id").cast("int").alias("quality"))).select("quality", F.posexplode("luma").alias("i", "step"))


@query(f"WITH i AS ({_SAMPLES}), t AS (SELECT y, x, (r - coalesce(lag(r) OVER (PARTITION BY y ORDER BY x), 0) + 256) % 256 AS delta, r FROM i) SELECT y, CAST(sum(r * (x + 1)) AS BIGINT) AS weighted, true AS equal FROM t GROUP BY y")
def horizontal_predictor(spark, d):
    """Rows coded as differences modulo 256 and summed back."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select(F.lit("plane").alias("image_id"), "y", "x", F.round(255 * color.clamp(F.col("v").cast("double") + 0.5, 0, 1)).cast("int").alias("r"))
    out = blocks.undo_horizontal(blocks.horizontal(e, "r", 8), "delta", 8)
    return out.groupBy("y").agg(F.sum(F.col("restored") * (F.col("x") + 1)).cast("long").alias("weighted"), F.bool_and(F.col("restored") == F.col("r")).alias("equal"))


@query("SELECT p_partkey, CAST(ceil(p_size / (8.0 * f)) * ceil((p_partkey % 97 + 1) / (8.0 * f)) AS BIGINT) AS units, CAST(ceil(p_size / (8.0 * f)) * 8 * f AS INTEGER) AS width, least(p_size - 1, p_size + 3) AS edge FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS f FROM part)")
def scan_geometry(spark, d):
    """Units and padded sizes of images with and without subsampling."""
    p = read(spark, d, "part").withColumn("f", F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(1))
    g = blocks.geometry(F.col("p_size"), (F.col("p_partkey") % 97 + 1).cast("int"), F.col("f"))
    return p.select("p_partkey", (g["across"] * g["down"]).alias("units"), g["width"].alias("width"), blocks.repeated(F.col("p_size") + 3, F.col("p_size")).alias("edge"))
