"""Codecs and operators against plain forms: round trips, greedy simulations, guards, and the two ways of mapping an image."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.codecs import container, exif, icc, jpeg, render, tiff, xmp
from lumenspark.functions import color, metadata, tone
from lumenspark.operators import conformance, encode, match, order, plane, settings, stats, surgery
from lumenspark.plans import catalog_files, options
from lumenspark.sources import files, patterns
from lumenspark.sources import tiff as tiffs

RNG = np.random.default_rng(1)


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 127 // max(1, h + w)], 2).astype(np.uint8)


@pytest.mark.parametrize("bits,little,compression,predictor", [(b, l, c, p) for b in (8, 16, 32) for l in (True, False) for c in (1, 5, 32773) for p in (1, 2, 3) if not (b == 32 and p == 2)])
def test_tiff_round_trips(bits, little, compression, predictor):
    v = RNG.random((37, 21, 3))
    for how in ({}, {"rows_per_strip": 5}, {"tile": 16}, {"planar": 2, "rows_per_strip": 7}, {"planar": 2, "tile": 16}, {"alpha": True}):
        _, got = tiff.decode(tiff.write(v, bits, little, compression=compression, predictor=predictor, **how))
        assert np.abs(got - v).max() < {8: 3e-3, 16: 2e-5, 32: 1e-6}[bits]


def test_tiff_odd_files():
    grey = RNG.random((10, 9, 1))
    assert np.abs(tiff.decode(tiff.write(grey, photometric=0))[1] - grey).max() < 2e-5
    long_ = (np.arange(200 * 300 * 3).reshape(200, 300, 3) // 7 % 251) / 255  # the table of codes fills up several times
    assert np.abs(tiff.decode(tiff.write(long_, 8, compression=tiff.LZW))[1] - long_).max() < 1e-6
    whole = tiff.write(RNG.random((8, 8, 3)), 8)
    for bad in (b"", b"II*\x00", whole[:20], b"MM\x00+" + bytes(12), whole[:-100]):
        with pytest.raises(tiff.TiffError):
            tiff.decode(bad)
    assert tiff.unpack_packbits(bytes((0x80, 2, 1, 2, 3, 0xFE, 9, 5)), 10) == bytes((1, 2, 3, 9, 9, 9, 0, 0, 0, 0))
    with pytest.raises(tiff.TiffError):
        tiff.unpack_lzw(bytes((0xFF, 0xFF, 0xFF)), 4)


@pytest.mark.parametrize("h,w", [(53, 41), (64, 64), (8, 8), (19, 37), (120, 160)])
def test_jpeg_round_trips(h, w):
    p = smooth(h, w)
    for subsample in (False, True):
        a, b = (jpeg.encode(p, jpeg.Options(95, subsample, best)) for best in (True, False))
        assert (jpeg.decode(a) == jpeg.decode(b)).all() and len(a) <= len(b)
        assert np.sqrt(((jpeg.decode(a).astype(float) - p) ** 2).mean()) <= (3.0 if not subsample else 13.0)
    grey = p[:, :, :1]
    assert np.sqrt(((jpeg.decode(jpeg.encode(grey)).astype(float) - grey) ** 2).mean()) <= 3.0


def test_jpeg_chroma_is_made_whole_smoothly():
    plane = np.array([[0.0, 8.0], [16.0, 40.0]])
    assert jpeg.smooth(plane)[:2].tolist() == [[0, 2, 6, 8], [4, 7, 13, 16]] and jpeg.smooth(plane)[3].tolist() == [16, 22, 34, 40]
    for k in (208, 212, 218, 470, 716):  # sharp edges of colour, halved
        assert next(catalog_files._coded(k, 0))[1:5] == (True, True, True, True)
    p = smooth(53, 41)
    assert not catalog_files._close(np.roll(p, 4, 1), p, jpeg.Options(50, True)) and not catalog_files._close(p[:, :, ::-1], p, jpeg.Options(50, True))


def test_jpeg_tables_and_guards():
    noise = RNG.integers(0, 256, (200, 220, 3)).astype(np.uint8)  # many rare symbols
    sizes = [len(jpeg.encode(noise, jpeg.Options(q))) for q in (5, 30, 70, 95)]
    assert sizes == sorted(sizes)
    assert (jpeg.decode(jpeg.encode(noise, jpeg.Options(100))) == jpeg.decode(jpeg.encode(noise, jpeg.Options(100, optimise=False)))).all()
    for bad in (np.zeros((0, 4, 3), np.uint8), np.zeros((4, 4, 2), np.uint8), np.zeros((4, 4), np.uint8), np.zeros((1, 65536, 1), np.uint8)):
        with pytest.raises(ValueError):
            jpeg.encode(bad)
    one = jpeg.optimal(np.bincount([7], minlength=256))
    assert one.symbols == (7,) and one.length[7] == 1 and one.code[7] == 0
    assert jpeg.scaled(jpeg.LUMA, 50).tolist() == jpeg.LUMA.tolist() and jpeg.scaled(jpeg.LUMA, 100).max() == 1
    assert len(container.icc(bytes(70_000))) == 2 and b"".join(s[18:] for s in container.icc(bytes(range(256)) * 300)) == bytes(range(256)) * 300
    with pytest.raises(container.FormatError):
        container.xmp("x" * 65_536)


def test_container_layouts():
    assert len(container.payload(container.GainMeta(multi=False))) == 89 and len(container.payload(container.GainMeta())) == 169
    assert len(container.index_body(container.types_of(2), [0, 0], [0, 0])) == 86 and len(container.base_marker()) == 36
    m = container.GainMeta(alt_headroom=2.3, lo=(-0.5, 0.0, 0.25))
    back = container.parse_payload(container.payload(m))
    assert back["multi"] and back["alt_headroom"] == 2.3 and [c[0] for c in back["channels"]] == [-0.5, 0.0, 0.25]
    little = container.MPF_ID + b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0xB001, 4, 1, 1) + struct.pack("<HHII", 0xB002, 7, 16, 38) + bytes(4) + struct.pack("<IIIHH", 0x30000, 5, 0, 0, 0)
    assert container.parse_index(little)["entries"] == [(0x30000, 5, 0)]
    assert container.parse_index(b"no index") is None and container.parse_index(container.MPF_ID + b"MM") is None
    assert container.split(b"\xff\xd8a\xff\xd9\xff\xd8b\xff\xd9") == [b"\xff\xd8a\xff\xd9", b"\xff\xd8b\xff\xd9"]
    for edit in (lambda d: container.drop_segment(d, 0xE1, b"x"), lambda d: container.insert_after(d, [(0xE2, b"MPF")], b""), container.recompute_index, lambda d: container.splice(d, d)):
        with pytest.raises(container.FormatError):
            edit(jpeg.encode(smooth(8, 8)))
    assert xmp.number(2.0**2.3) == "4.92458" and xmp.property_form("a:b", '<x a:b = "1"/>') == ("1", "attribute") and xmp.property_form("a:b", "<x/>") == (None, None)


def test_exif_of_a_tiff():
    data = tiff.write(RNG.random((4, 4, 3)), 8, more=((271, 2, 5, b"ACME\x00"), (274, 3, 1, struct.pack("<H", 6)), (33432, 2, 70_000, b"c" * 70_000)), exif=[(33434, 5, 1, struct.pack("<II", 1, 60)), (37500, 7, 6, b"secret")], gps=[(1, 2, 2, b"N\x00")])
    h = tiff.header(data)
    dirs = {n: exif.carried(data, at, h.little, n) for n, at in (("ifd0", h.ifd0), ("exif", h.exif), ("gps", h.gps))}
    body = exif.app_payload(exif.completed(dirs, 4, 4, False))[6:]
    found = {t: v for t, _, _, v in exif.directory(body, 8, False)}
    own = {t: v for t, _, _, v in exif.directory(body, int.from_bytes(found[exif.EXIF_POINTER]), False)}
    assert found[271] == b"ACME\x00" and found[274] == b"\x00\x01" and 33432 not in found and list(found) == sorted(found)
    assert own[33434] == struct.pack(">II", 1, 60) and 37500 not in own and own[40961] == b"\xff\xff" and own[40962] == struct.pack(">I", 4)
    assert exif.app_payload({"ifd0": [exif.Tag(270, 2, 65_000, b"x" * 65_000), exif.Tag(315, 2, 900, b"y" * 900)]}) == b""


def test_bodies_of_segments_are_made_once(spark):
    assert str(metadata.icc_chunks(F.col("own_body"))).count("own_body") == str(metadata.segment(0xE1, F.col("own_body"))).count("own_body") == 1
    rows = [(k, bytearray(range(256)) * 256 * k + bytearray(b"end")) for k in range(3)]
    df = spark.createDataFrame([*rows, (3, None), (4, bytearray())], "k int, b binary").select("k", metadata.icc_chunks(F.col("b")).alias("c"), metadata.segment(0xE1, F.col("b")).alias("s"))
    got = {r["k"]: r for r in df.collect()}
    for k, b in rows:
        n = -(-len(b) // container.ICC_CHUNK)
        cut = [bytes(b[i * container.ICC_CHUNK : (i + 1) * container.ICC_CHUNK]) for i in range(n)]
        assert [bytes(c) for c in got[k]["c"]] == [container.segment(0xE2, container.ICC_ID + bytes((i, n)) + c) for i, c in enumerate(cut, 1)]
    assert bytes(got[0]["s"]) == container.segment(0xE1, b"end") and got[1]["s"] is None and got[3]["s"] is None and got[3]["c"] == got[4]["c"] == []


def test_colour_profiles():
    for n in icc.CANDIDATES:
        s = icc.inspect(icc.rgb_profile(n))
        assert (s.valid, s.primaries, s.transfer) == (True, n, "srgb")
    p = icc.rgb_profile("p3")
    assert not icc.inspect(p[:-1]).valid and not icc.inspect(None).valid and icc.inspect(p[:128] + struct.pack(">I", 257) + p[132:]).valid is False
    para = lambda fn, *v: b"para" + bytes(4) + struct.pack(">HH", fn, 0) + b"".join(map(icc.fixed, v))
    assert icc._curve_class(para(0, 1.8)) == "gamma18" and icc._curve_class(para(3, 2.4, 1, 0, 0, 0)) == "srgb" and icc._curve_class(b"curv" + bytes(8)) == "linear"


def greedy(rows, taken=()):
    """Names claimed one after the other."""
    claimed, out = set(taken), {}
    for at, stem in sorted(rows):
        name, n = stem, 0
        while name in claimed:
            n += 1
            name = f"{stem}-{n}"
        claimed.add(name)
        out[at] = name
    return out


def test_unique_names(spark):
    rng = random.Random(5)
    cases = [([(0, "a"), (1, "a"), (2, "a-1")], ()), ([(0, "a-1"), (1, "a"), (2, "a"), (3, "a")], ()), ([(0, "pool_1"), (1, "dup"), (2, "dup-1"), (3, "dup")], ("dup",))]
    for k in range(4):
        stems = ["a", "a-1", "a-2", "a-1-1", "a-10", "a-02", "b", "b-3", "-1"]
        cases.append(([(i, rng.choice(stems[: 4 + k * 2])) for i in range(80)], ("a-3", "b", "a-1-2") if k % 2 else ()))
    for rows, taken in cases:
        df = spark.createDataFrame(rows, "at long, stem string")
        old = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
        got = {r["at"]: r["name"] for r in match.unique_names(df, "stem", "at", old).collect()}
        assert got == greedy(rows, taken)
    odd = spark.createDataFrame([(0, None), (1, "x")], "at long, stem string")
    assert {r["at"]: r["name"] for r in match.unique_names(odd, "stem", "at").collect()} == {0: None, 1: "x"}


def test_numbering_matching_and_percentiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, *range(1000)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, i long")
    for spans in (1, 7, 256):
        got = order.numbered(df, ["k"], "o", "n", spans).collect()
        for k in "ab":
            own = sorted((r["n"], -1 if r["o"] is None else r["o"]) for r in got if r["k"] == k)
            assert [n for n, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
    vec = spark.createDataFrame([(i, RNG.random(6).tolist()) for i in range(50)] + [(50, None), (51, [1.0, 2.0])], "id long, vec array<double>")
    a = match.best_match(vec, vec.where("id % 5 = 0"), block=4).collect()
    b = match.best_match(vec, vec.where("id % 5 = 0")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and {r["received"]: r["sent"] for r in a}[10] == 10 and len(a) == 50
    assert match.best_match(vec, vec.where("false")).count() == 0
    s = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert stats.indexed_percentiles(s, "v", {"half": 0.5}).first()["half"] == 3.0


def test_options():
    o = options.parse("--input a --output b --headroom 3 --sdr-lift 0.5 --auto-shape --color-space DisplayP3 --apple-compatible".split())
    assert (o.headroom, o.sdr_lift, o.shape, o.color_space, o.multi) == (3.0, 0.5, "auto", "p3", False) and options.parse(["--version"]).handled == "version"
    for bad in ("--input a", "--input", "--x", "--input a --output b -q 0", "--input a --output b --subsample 2.5", "--input a --output b --subsample 3", "--input a --output b --color-space auto", "--input a --output b --sdr-knee 1", "--input a --output b --gamma 0", "--input a --output b --threads -1", "--input a --output b --headroom 1_0", "--input a --output b --peak-detect hard", "--input a --output b --highlight-knee nan"):
        with pytest.raises(options.OptionError):
            options.parse(bad.split())


def test_transfer_functions_in_both_forms(spark):
    v = np.linspace(-0.2, 1.3, 61)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for name in ("linear", "srgb", "gamma18", "gamma22", "romm", "pq", "hlg"):
        got = np.array([r[0] for r in df.select(color.decode(name, F.col("v"))).collect()])
        assert np.allclose(got, render.light(name, v, 203.0), rtol=1e-9, atol=1e-12), name
    assert math.isclose(float(render.light("pq", np.array([1.0]), 203.0)[0]), 10000 / 203, rel_tol=1e-9)


def test_tone_operators_keep_their_promises(spark):
    """Monotone, never brighter, identity below the knee, one factor for all channels."""
    l = [i / 100 for i in range(1, 801)]
    df = spark.createDataFrame([(x,) for x in l], "l double")
    for top in (0.5, 1.5, 2.3, 4.0):
        out = [r[0] for r in df.select(tone.compress_base(tone.log_luminance(F.col("l")), tone.knee_start(top), top)).collect()]
        assert all(b >= a - 1e-12 for a, b in zip(out, out[1:], strict=False)) and all(o <= math.log2(x) + 1e-9 for o, x in zip(out, l, strict=True))
    s = [r[0] for r in df.select(tone.soft_shoulder(F.col("l"), 0.75)).collect()]
    assert all(a == b for a, b in zip(s, l, strict=True) if b <= 0.75) and max(s) <= 1.0


def test_an_image_is_mapped_alike_by_rows_and_by_arrays(spark):
    """The column expressions over pixels and the array form that encodes files."""
    p = patterns.detailed_pattern(spark, 48, 40, 6.0, "i")
    rows = p.orderBy("y", "x").collect()
    v = np.array([[r["r"], r["g"], r["b"]] for r in rows]).reshape(40, 48, 3)
    o = options.EncodeOptions(input_primaries="p3", subsample=2)
    r = render.render(v, o, "p3", "linear")
    w = color.weights("p3")
    lum = p.withColumn("l", F.greatest(F.lit(0.0), color.dot(w, F.col("r"), F.col("g"), F.col("b"))))
    peaks = stats.peaks(lum, 1).first()
    assert math.isclose(peaks["headroom"], r.stats["measuredHeadroom"], rel_tol=1e-9)
    guide = stats.block_means(lum, 1, F.col("l")).withColumn("v", tone.log_luminance(F.col("v"))).withColumnsRenamed({"gy": "y", "gx": "x"})
    base = plane.guided_filter(guide, plane.guide_radius(48, 40), 4.0).withColumnsRenamed({"y": "gy", "x": "gx"})
    held = stats.held(p, stats.channel_ceilings(p, 1)).withColumn("l", color.dot(w, F.col("r"), F.col("g"), F.col("b")))
    mapped = plane.bilinear(held, base, 1)
    top = float(r.declared)
    scale = tone.highlight_scale(F.col("r"), F.col("g"), F.col("b"), tone.local_scale(F.col("l"), F.col("base"), tone.knee_start(top), top), 0.8)
    out = mapped.select("y", "x", *[tone.sdr_pixel(F.col(c), scale).alias(c) for c in "rgb"]).orderBy("y", "x").collect()
    got = np.array([[q["r"], q["g"], q["b"]] for q in out]).reshape(40, 48, 3)
    assert np.abs(got.astype(int) - r.sdr).max() <= 1 and (got != r.sdr).mean() < 0.01


def test_encoding_gives_the_scene_back():
    y, x = np.mgrid[0:96, 0:128]
    v = np.repeat((0.18 + 0.5 * x / 127)[:, :, None], 3, 2)
    v[30:50, 80:110] = 6.0
    data = tiff.write(v, 32)
    for how in ({}, {"subsample": 2}, {"rgb": False}, {"apple": True}, {"tone_map": "reinhard"}, {"tone_map": "filmic", "shape": "manual"}, {"tone_map": "clip"}, {"gamma": 0.5}, {"chroma_subsample": True}):
        o = options.EncodeOptions(input_primaries="p3", quality=97, gainmap_quality=97, **how)
        made, report = encode.encode(data, o)
        back = encode.reconstruction(made, o.subsample).mean(2)
        assert abs(report["measuredHeadroom"] - math.log2(6)) < 0.15
        assert np.median(np.abs(back - v.mean(2)) / v.mean(2)) < 0.08
        assert not [row for row in conformance.rules_of(made) if row[1] and not row[2]]
    for bare in ({"icc": False}, {"exif": False}, {"xmp": False}, {"optimise": False}):
        assert encode.encode(data, options.EncodeOptions(input_primaries="p3", **bare))[0][:2] == container.SOI
    flat = tiff.write(np.zeros((9, 9, 1)), 8)
    assert encode.encode(flat, options.EncodeOptions())[1]["declaredHeadroom"] == 0.05
    assert encode.encode(tiff.write(v / 8, 16), options.EncodeOptions())[1]["inputTransfer"] == "romm"


def test_space_resolution():
    o, known = options.EncodeOptions, icc.Summary(valid=True, primaries="prophoto", transfer="gamma18")
    assert encode.resolve_space(o(), False, known) == ("prophoto", "romm") and encode.resolve_space(o(), True, known) == ("prophoto", "linear")
    assert encode.resolve_space(o(input_primaries="srgb"), False, icc.Summary()) == ("srgb", "srgb") and encode.resolve_space(o(input_transfer="pq"), True, known) == ("prophoto", "pq")
    assert encode.resolve_space(o(), False, icc.Summary(valid=False, primaries="p3")) == ("prophoto", "romm")


def test_files_written_and_failures(spark, tmp_path):
    rows = [(f"/in/{k}.jpg", bytearray(bytes([k]) * 100)) for k in range(5)] + [("/in/bad.jpg", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert encode.write_files(df, str(tmp_path)).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == [f"{k}.jpg" for k in range(5)]
    assert files.read_files(spark, f"file://{tmp_path}/*.jpg").count() == 5
    failed = encode.encode_files(spark.createDataFrame([("x", bytearray(b"II*\x00")), ("y", None)], "path string, content binary")).collect()
    assert all(not r["ok"] and r["error"] and r["content"] is None for r in failed)
    edited = surgery.recomputed(df.where("path <> '/in/bad.jpg'")).collect()
    assert all(r["content"] is None and r["problem"] for r in edited)
    assert tiffs.segments(df).count() == 0 and tiffs.images(df).where("accepted").count() == 0


def test_settings_and_patterns(spark):
    m = spark.createDataFrame([({"iso_target_headroom": "4.0", "iso_gainmap_gamma": "2.2"},), ({},), ({"iso_target_headroom": "4.0", "iso_settings_version": "6"},)], "s map<string,string>")
    got = [r[0] for r in m.select(settings.completed(F.col("s"))).collect()]
    assert got[0]["iso_target_headroom"] == "match" and "iso_gainmap_gamma" not in got[0] and got[2]["iso_target_headroom"] == "4.0" and got[1]["iso_workers"] == "3"
    assert m.select(settings.inverted_gamma(F.element_at("s", F.lit("iso_gainmap_gamma")))).first()[0] == "0.4545"
    assert [r[0] for r in m.select(settings.workers(F.col("s"))).collect()] == [3, 3, 3]
    assert spark.range(1).select(metadata.property_form("a:b", F.lit("<a:b><rdf:li>1</rdf:li><rdf:li x='1'> 2 </rdf:li></a:b>")).alias("p")).first()["p"] == ("1, 2", "seq")
    card = patterns.test_card(spark, patterns.letters(spark, {"I": ["#####"] * 7}, "I", 300, 210, 4, 4.0))
    assert card.where("l = 4.0 AND y BETWEEN 210 AND 237 AND x BETWEEN 300 AND 319").count() == 20 * 28
    with pytest.raises(ValueError):
        patterns.letters(spark, {}, "Q", 0, 0, 1, 1.0)
    a = patterns.lognormal_scene(spark, 0.2, 1.6, 300, part=300).collect()
    b = patterns.lognormal_scene(spark, 0.2, 1.6, 300, part=7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_settings_are_completed_once_a_row(spark):
    c = F.col("own_map")
    for made in (settings.completed(c), settings.arguments(c), settings.summary(c), settings.overlaid(F.create_map(), c)):
        assert str(made).count("own_map") == 1
    df = spark.createDataFrame([(1, {"iso_gainmap_gamma": "2", "iso_target_headroom": "4.0"}), (2, {"iso_settings_version": "6", "iso_gainmap_gamma": "2"}), (3, None), (4, {"x": None})], "k int, settings map<string,string>")
    got = {r["k"]: r for r in settings.presets(df).collect()}
    assert got[1]["completed"] == settings.DEFAULTS | {"iso_settings_version": "6"} == got[4]["completed"] and got[3]["completed"] is None
    assert got[2]["completed"] == settings.DEFAULTS | {"iso_settings_version": "6", "iso_gainmap_gamma": "2"} and got[2]["arguments"] == got[1]["arguments"]


def test_files_encoded_as_they_arrive(spark, tmp_path):
    from lumenspark.streaming import watch

    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    run = lambda: watch.encode_arriving(spark, f"file://{inbox}", f"file://{out}", f"file://{state}", options.EncodeOptions(input_primaries="p3"), once=True, files_per_trigger=1).awaitTermination(120)
    for k in range(2):
        (inbox / f"{k}.tif").write_bytes(tiff.write(RNG.random((8, 8, 3)), 32))
    (inbox / "note.txt").write_text("left alone")
    run()
    (inbox / "bad.tif").write_bytes(b"no image")
    run()
    got = {r["path"].rpartition("/")[2]: r["ok"] for r in spark.read.parquet(f"file://{out}").collect()}
    assert got == {"0.tif": True, "1.tif": True, "bad.tif": False}
