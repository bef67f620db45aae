"""Export settings as a map column: defaults, migration of old presets, checks, argument lists, and the small text helpers of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bound

# Names and defaults of the settings, the settings that are no more, and the render settings that an export forces.
DEFAULTS = {
    "iso_add_to_catalog": "false", "iso_color_space": "DisplayP3", "iso_copy_metadata": "true", "iso_input_primaries": "auto", "iso_input_transfer": "auto", "iso_jpeg_quality": "90",
    "iso_keep_intermediate": "false", "iso_pq_diffuse_white": "203", "iso_sdr_detail": "1.25", "iso_settings_version": "1", "iso_target_headroom": "match", "iso_workers": "3",
}
RETIRED = (
    "iso_gainmap_subsample", "iso_gainmap_channels", "iso_gainmap_quality", "iso_gainmap_gamma", "iso_chroma_subsample", "iso_peak_detect", "iso_auto_max_boost",
    "iso_sdr_shape", "iso_tone_map", "iso_sdr_lift", "iso_sdr_contrast", "iso_apple_compatible",
)
SIGNS = ("iso_gainmap_channels", "iso_target_headroom", "iso_gainmap_gamma")
VERSION = 6
FORCED = {
    "LR_format": "TIFF", "LR_export_bitDepth": "16", "LR_export_colorSpace": "ProPhotoRGB", "LR_tiff_compressionMethod": "compressionMethod_None",
    "LR_export_useHDR": "true", "LR_export_maximizeCompatibility": "false",
}
FORCED_IF_PRESENT = {"LR_tiff_preserveTransparency": "false", "LR_reimportExportedPhoto": "false", "LR_removeLocationMetadata": "false"}
NO_CAP = 10.0


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _number(v: Column) -> Column:
    return F.trim(v).try_cast("double")


def overlaid(base: Column, over: Column) -> Column:
    """Two maps as one; the second wins."""
    return bound(over, lambda o: bound(F.map_keys(o), lambda keys: F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(keys, k)), o)))


def clamp_number(v: Column, low: float, high: float, otherwise: float) -> Column:
    n = _number(v)
    return F.when(n.isNull(), float(otherwise)).otherwise(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n)))


def preset_fields() -> list[tuple[str, str]]:
    """(key, default) of every setting, by key."""
    return sorted(DEFAULTS.items())


def inverted_gamma(gamma: Column) -> Column:
    """A gamma of the old meaning (over 1) as its reciprocal with four decimals; others as they are."""
    g = _number(gamma)
    return F.when(g > 1, F.format_string("%.4f", 1 / F.nullif(g, F.lit(0.0)))).otherwise(gamma)


def completed(settings: Column) -> Column:
    """Settings brought to the present version: old presets lose retired settings and old defaults, absent ones are filled in. Doing it again changes nothing."""
    return bound(F.map_filter(settings, lambda _, v: v.isNotNull()), _completed)


def _completed(present: Column) -> Column:
    has = lambda k: F.map_contains_key(present, k)
    version = _number(F.element_at(present, F.lit("iso_settings_version")))
    old = (has(SIGNS[0]) | has(SIGNS[1]) | has(SIGNS[2])) & (version.isNull() | (version < VERSION))
    kept = F.map_filter(present, lambda k, _: ~k.isin(*RETIRED))
    kept = F.transform_values(kept, lambda k, v: F.when((k == "iso_target_headroom") & (v == "4.0"), "match").otherwise(v))
    return overlaid(overlaid(_map(DEFAULTS), F.when(old, kept).otherwise(present)), _map({"iso_settings_version": str(VERSION)}))


def _at(settings: Column, key: str) -> Column:
    return F.element_at(settings, F.lit(key))


def headroom_cap(settings: Column) -> Column:
    h = _at(settings, "iso_target_headroom")
    return F.when(h == "match", NO_CAP).otherwise(clamp_number(h, 0.1, NO_CAP, 4.0))


def problem(settings: Column) -> Column:
    """What is wrong with the settings, or null."""
    h, q = _at(settings, "iso_target_headroom"), _number(_at(settings, "iso_jpeg_quality"))
    n = _number(h)
    bad_headroom = ~h.eqNullSafe(F.lit("match")) & (n.isNull() | (n <= 0) | (n > 10))
    return F.when(bad_headroom, "target headroom must be between 0 and 10 stops").when(q.isNull() | (q < 1) | (q > 100), "quality must be between 1 and 100")


def render_problems(settings: Column) -> Column:
    """Which render settings leave no highlights to encode: an array, empty if none does."""
    depth = F.coalesce(_number(_at(settings, "LR_export_bitDepth")), F.lit(8.0))
    found = F.array(F.when(~_at(settings, "LR_format").eqNullSafe(F.lit("TIFF")), "format"), F.when(depth < 16, "bit depth"), F.when(_at(settings, "LR_export_useHDR") == "false", "hdr off"))
    return F.array_compact(found)


def with_forced(settings: Column) -> Column:
    """Settings with the render settings that an export needs; some are touched only where they exist."""
    there = F.map_filter(_map(FORCED_IF_PRESENT), lambda k, _: F.map_contains_key(settings, k))
    return overlaid(settings, F.map_concat(_map(FORCED), there))


def _plain(v: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def arguments(settings: Column) -> Column:
    """Argument list of completed settings, without the paths."""
    return bound(completed(settings), _arguments)


def _arguments(p: Column) -> Column:
    at = lambda k: _at(p, k)
    flag = lambda name, v, when: F.when(when, F.array(F.lit(name), v)).otherwise(F.array().cast("array<string>"))
    transfer, space = at("iso_input_transfer"), at("iso_input_primaries")
    listed = F.array(
        F.lit("--headroom"), F.format_string("%.4f", headroom_cap(p)), F.lit("--color-space"), at("iso_color_space"),
        F.lit("--quality"), F.floor(clamp_number(at("iso_jpeg_quality"), 1, 100, 90)).cast("string"), F.lit("--json"), F.lit("--tone-map"), F.lit("local"),
        F.lit("--sdr-detail"), F.format_string("%.2f", clamp_number(at("iso_sdr_detail"), 0, 2, 1.25)), F.lit("--apple-compatible"), F.lit("--subsample"), F.lit("2"),
    )
    return F.concat(
        listed,
        F.when(at("iso_copy_metadata") == "false", F.array(F.lit("--no-exif"))).otherwise(F.array().cast("array<string>")),
        flag("--input-transfer", transfer, transfer != "auto"),
        flag("--input-primaries", space, space != "auto"),
        flag("--pq-diffuse-white", _plain(clamp_number(at("iso_pq_diffuse_white"), 10, 10000, 203)), transfer.isin("pq", "hlg")),
    )


def summary(settings: Column) -> Column:
    """One line that says what an export will do."""
    return bound(completed(settings), _summary)


def _summary(p: Column) -> Column:
    h = _at(p, "iso_target_headroom")
    headroom = F.when(h == "match", "headroom from the render").otherwise(F.format_string("max +%s EV", h))
    quality = F.floor(F.coalesce(_number(_at(p, "iso_jpeg_quality")), F.lit(90.0))).cast("long")
    return F.format_string("%s / depth %.2f / %s / q%d", headroom, clamp_number(_at(p, "iso_sdr_detail"), 0, 2, 1.25), _at(p, "iso_color_space"), quality)


def workers(settings: Column) -> Column:
    """How many images are encoded at once; Spark's own scheduler holds to its cores."""
    return F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.coalesce(_number(_at(settings, "iso_workers")), F.lit(3.0))).cast("int")))


# text helpers -----------------------------------------------------------------------------------
def quoted(v: Column) -> Column:
    """A shell word."""
    return F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def error_text(stderr: Column) -> Column:
    """What follows the first 'error:' without blanks at its ends, or the whole text."""
    return F.when(F.contains(stderr, F.lit("error:")), F.regexp_extract(stderr, r"(?s)error:\s*(.*?)\s*$", 1)).otherwise(stderr)


def filled(template: Column, *values: Column) -> Column:
    """A message without its key, with ^1, ^2, ... replaced."""
    out = F.regexp_replace(template, r"^\$\$\$/[A-Za-z0-9/_.]+=", "")
    for i, v in enumerate(values, 1):
        out = F.replace(out, F.lit(f"^{i}"), v)
    return out


def leaf(path: Column) -> Column:
    """The last part of a path; the path itself if it ends in a separator."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.when(name == "", path).otherwise(name)


def parent(path: Column) -> Column:
    """What stands before the last separator; null without one."""
    return F.when(F.regexp_like(path, F.lit(r"[/\\]")), F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*$", 1))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]+$", "")


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(without_extension(path), F.lit("." + ext))


def report(text: Column, schema: str) -> Column:
    """The flat JSON object within a text as a struct; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(\{[^{}]*\})", 1), F.lit("")), schema)


def presets(df: DataFrame, settings: str = "settings") -> DataFrame:
    """Rows with their settings completed, checked and made into an argument list."""
    own = lambda p: F.struct(p.alias("completed"), problem(p).alias("problem"), _arguments(p).alias("arguments"), _summary(p).alias("summary"))
    made = df.withColumn("_made", bound(completed(F.col(settings)), own))
    return made.withColumns({c: F.col("_made")[c] for c in ("completed", "problem", "arguments", "summary")}).drop("_made")
