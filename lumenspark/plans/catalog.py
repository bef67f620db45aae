"""Registry of the engine's queries and of the SQL that checks them.

The tables stand in for images: ``embeddings`` is a plane (row vec_id, column position, luminance
2^(8 v)), ``lineitem`` a bag of RGB samples, ``events`` a bag of luminances.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, tone
from ..operators import gain, match, plane, stats
from .registry import QUERIES, SQL, query
from .registry import read as _read

def _plane(spark, d, value=lambda v: F.pow(F.lit(2.0), 8 * v)):
    """(image_id, y, x, l) of the embeddings."""
    e = _read(spark, d, "embeddings").select(F.lit("plane").alias("image_id"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return e.select("image_id", "y", "x", value(F.col("e").cast("double")).alias("l"))


def _rgb(spark, d):
    """(flag, r, g, b) of the line items."""
    return _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 50000).alias("r"), (F.col("l_quantity") / 25).alias("g"), (F.col("l_tax") * 12.5).alias("b"))


def _luma(spark, d):
    return _read(spark, d, "events").select("event_type", (F.col("value") / 100).alias("l"))


E_SQL = "SELECT 'plane' AS image_id, vec_id AS y, CAST(p - 1 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS e FROM embeddings, range(1, 65) t(p)"
P_SQL = f"p AS (SELECT image_id, y, x, pow(2.0, 8 * e) AS l FROM ({E_SQL}))"
RGB_SQL = "c AS (SELECT l_returnflag AS flag, l_extendedprice / 50000 AS r, l_quantity / 25 AS g, l_tax * 12.5 AS b FROM lineitem)"
L_SQL = "s AS (SELECT event_type, value / 100 AS l FROM events)"
BIN = "CAST(greatest(0, least(383, round((log2(l) + 14) * 16))) AS INTEGER)"
H_SQL = f"h AS (SELECT {BIN} AS bin, count(*) AS n FROM s WHERE l > 0 GROUP BY 1)"


def _r(c, n=6):
    return F.round(c, n)


# transfer functions -----------------------------------------------------------------------------
def _transfer(name):
    def run(spark, d):
        v = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 90000).alias("v"))
        out = color.decode(name, F.col("v"))
        return v.groupBy("flag").agg(_r(F.avg(out)).alias("mean"), _r(F.max(out)).alias("top"), F.count("*").alias("n"))

    run.__name__ = f"transfer_{name}"
    return run


_PQ, _HLG = color.PQ, color.HLG
_T = {
    "linear": "v",
    "srgb": "CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END",
    "gamma22": "CASE WHEN v <= 0 THEN 0 ELSE pow(v, 2.2) END",
    "gamma18": "CASE WHEN v <= 0 THEN 0 ELSE pow(v, 1.8) END",
    "romm": "CASE WHEN v < 0.031248 THEN v / 16 ELSE pow(v, 1.8) END",
    "pq": f"pow(greatest(pow(v, 1 / {_PQ['m2']}) - {_PQ['c1']}, 0) / ({_PQ['c2']} - {_PQ['c3']} * pow(v, 1 / {_PQ['m2']})), 1 / {_PQ['m1']}) * 10000 / 203",
    "hlg": f"pow(CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - {_HLG['c']}) / {_HLG['a']}) + {_HLG['b']}) / 12 END, 1.2) * 1000 / 203",
}
for _name, _sql in _T.items():
    query(f"SELECT flag, round(avg({_sql}), 6) AS mean, round(max({_sql}), 6) AS top, count(*) AS n FROM (SELECT l_returnflag AS flag, l_extendedprice / 90000 AS v FROM lineitem) GROUP BY flag")(_transfer(_name))


def _dot_sql(w):
    return " + ".join(f"({x!r}) * {c}" for x, c in zip([float(v) for v in w], "rgb", strict=True))


_M = color.conversion("srgb", "p3")


@query(f"WITH {RGB_SQL} SELECT flag, " + ", ".join(f"round(avg({_dot_sql(_M[i])}), 6) AS {c}" for i, c in enumerate(("p3_r", "p3_g", "p3_b"))) + " FROM c GROUP BY flag")
def color_matrix_p3(spark, d):
    r, g, b = color.convert(_M, F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, d).groupBy("flag").agg(_r(F.avg(r)).alias("p3_r"), _r(F.avg(g)).alias("p3_g"), _r(F.avg(b)).alias("p3_b"))


@query(f"WITH {RGB_SQL} SELECT flag, round(avg({_dot_sql(color.folded_weights('srgb', 'rec2020'))}), 6) AS luminance, round(avg(CASE WHEN greatest(r, g, b) > 1e-6 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END), 6) AS saturation FROM c GROUP BY flag")
def fused_luminance(spark, d):
    c = [F.col(x) for x in "rgb"]
    return _rgb(spark, d).groupBy("flag").agg(_r(F.avg(color.dot(color.folded_weights("srgb", "rec2020"), *c))).alias("luminance"), _r(F.avg(color.saturation(*c))).alias("saturation"))


@query(f"WITH {L_SQL} SELECT event_type, round(avg(CASE WHEN least(greatest(l, 0), 1) <= 0.0031308 THEN least(greatest(l, 0), 1) * 12.92 ELSE 1.055 * pow(least(greatest(l, 0), 1), 1 / 2.4) - 0.055 END), 6) AS coded FROM s GROUP BY event_type")
def encode_srgb(spark, d):
    return _luma(spark, d).groupBy("event_type").agg(_r(F.avg(color.encode_srgb(F.col("l")))).alias("coded"))


# tone curves ------------------------------------------------------------------------------------
_A, _B, _C, _D, _E, _F = tone.HABLE


def _hable_sql(x):
    return f"(({x} * ({_A} * {x} + {_C} * {_B}) + {_D} * {_E}) / ({x} * ({_A} * {x} + {_B}) + {_D} * {_F}) - {_E} / {_F})"


_CURVE = {"clip": "least(l, 1.0)", "reinhard": "least(1.0, l * (1 + l / 16.0) / (1 + l))", "filmic": f"least(1.0, {_hable_sql('l')} / {_hable_sql('4.0')})"}
for _name, _sql in _CURVE.items():

    def _run(spark, d, name=_name):
        return _luma(spark, d).groupBy("event_type").agg(_r(F.avg(tone.curve(name, F.col("l"), 4.0))).alias("mean"), _r(F.avg(tone.shaped(name, F.col("l"), 4.0, 0.43, 1.14))).alias("shaped"))

    _run.__name__ = f"tone_{_name}"
    query(f"WITH {L_SQL} SELECT event_type, round(avg({_sql}), 6) AS mean, round(avg(pow({_sql} * pow(2.0, 0.43), 1.14) * pow(0.18, 1 - 1.14)), 6) AS shaped FROM s GROUP BY event_type")(_run)


@query(f"WITH {L_SQL} SELECT event_type, round(avg(CASE WHEN l <= 0.8 THEN l ELSE 0.8 + 0.2 * (1 - exp(-(l - 0.8) / 0.2)) END), 6) AS v FROM s GROUP BY event_type")
def soft_shoulder(spark, d):
    return _luma(spark, d).groupBy("event_type").agg(_r(F.avg(tone.soft_shoulder(F.col("l"), 0.8))).alias("v"))


def _compress_sql(b, k, m):
    return f"CASE WHEN {b} <= {k} THEN {b} ELSE {k} + (0 - {k}) * (1 - exp(-(({m} - {k}) / (0 - {k})) * least(1.0, greatest(0.0, ({b} - {k}) / ({m} - {k}))))) END"


_LOG = "greatest(-20.0, log2(greatest(l, 1e-7)))"


@query(f"WITH {L_SQL} SELECT event_type, round(avg({_compress_sql(_LOG, '-1.955', '2.3')}), 6) AS v FROM s GROUP BY event_type")
def compress_base(spark, d):
    return _luma(spark, d).groupBy("event_type").agg(_r(F.avg(tone.compress_base(tone.log_luminance(F.col("l")), tone.knee_start(2.3), 2.3))).alias("v"))


@query(f"WITH {RGB_SQL}, q AS (SELECT flag, greatest(r, g, b) * 0.7 AS k FROM c) SELECT flag, round(avg(0.7 * (CASE WHEN k <= 0.8 THEN k ELSE 0.8 + 0.2 * (1 - exp(-(k - 0.8) / 0.2)) END) / k), 6) AS s FROM q GROUP BY flag")
def highlight_scale(spark, d):
    return _rgb(spark, d).groupBy("flag").agg(_r(F.avg(tone.highlight_scale(F.col("r"), F.col("g"), F.col("b"), F.lit(0.7), 0.8))).alias("s"))


# measurements -----------------------------------------------------------------------------------
@query(f"WITH {P_SQL}, b AS (SELECT image_id, y // 2 AS gy, x // 2 AS gx, avg(l) AS v FROM p GROUP BY ALL), m AS (SELECT image_id, max(v) AS softened FROM b GROUP BY 1), t AS (SELECT image_id, max(l) AS peak FROM p GROUP BY 1) SELECT image_id, round(peak, 6) AS peak, round(softened, 6) AS softened, round(log2(softened), 6) AS headroom, round(log2(peak), 6) AS true_headroom FROM m JOIN t USING (image_id)")
def block_mean_peak(spark, d):
    return stats.peaks(_plane(spark, d), 2).select("image_id", *[_r(F.col(c)).alias(c) for c in ("peak", "softened", "headroom", "true_headroom")])


@query(f"WITH {P_SQL}, b AS (SELECT y // 2 AS gy, x // 2 AS gx, avg(greatest(0, l)) AS r, avg(greatest(0, l * 0.75)) AS g, avg(greatest(0, l - 1)) AS b FROM p GROUP BY ALL) SELECT round(max(r), 6) AS r, round(max(g), 6) AS g, round(max(b), 6) AS b FROM b")
def channel_ceiling(spark, d):
    p = _plane(spark, d).select("image_id", "y", "x", F.col("l").alias("r"), (F.col("l") * 0.75).alias("g"), (F.col("l") - 1).alias("b"))
    return stats.channel_ceilings(p, 2).select(*[_r(F.col(f"ceil_{c}")).alias(c) for c in "rgb"])


@query(f"WITH {L_SQL}, {H_SQL} SELECT bin, n FROM h")
def log_histogram(spark, d):
    return stats.log_histogram(_luma(spark, d))


def _pct_sql(f):
    return f"pow(2.0, CASE WHEN floor({f} * max(total)) = 0 THEN 0 ELSE min(CASE WHEN cum >= floor({f} * total) THEN bin END) END / 16.0 - 14)"


_RUN = "r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h)"


@query(f"WITH {L_SQL}, {H_SQL}, {_RUN} SELECT round({_pct_sql(0.25)}, 6) AS q25, round({_pct_sql(0.5)}, 6) AS median, round({_pct_sql(0.99)}, 6) AS p99, CAST(max(total) AS BIGINT) AS total FROM r")
def hist_percentile(spark, d):
    p = stats.percentile(stats.log_histogram(_luma(spark, d)), {"q25": 0.25, "median": 0.5, "p99": 0.99})
    return p.select(*[_r(F.col(c)).alias(c) for c in ("q25", "median", "p99")], "total")


@query(f"WITH {L_SQL}, {H_SQL} SELECT round(sum(CASE WHEN bin > 224 THEN n ELSE 0 END) / sum(n), 6) AS above FROM h")
def fraction_above_white(spark, d):
    return stats.fraction_above(stats.log_histogram(_luma(spark, d)), 1.0).select(_r(F.col("above")).alias("above"))


_TOP = 2.0**2.3


def _rein(x):
    return f"least(1.0, {x} * (1 + {x} / {_TOP * _TOP!r}) / (1 + {x}))"


@query(
    f"WITH {L_SQL}, {H_SQL}, {_RUN}, q AS (SELECT least(1.0, {_pct_sql(0.25)}) AS q1, least(1.0, {_pct_sql(0.5)}) AS a, least(1.0, {_pct_sql(0.75)}) AS q3 FROM r), "
    f"w AS (SELECT *, CASE WHEN q1 > 0 AND q1 < q3 AND {_rein('q1')} < {_rein('q3')} THEN log2({_rein('q3')} / {_rein('q1')}) END AS got FROM q), "
    "k AS (SELECT *, CASE WHEN got > 1e-4 THEN least(1.5, greatest(1.0, 1 + 0.4 * (log2(q3 / q1) / got - 1))) ELSE 1.0 END AS c FROM w) "
    f"SELECT round(a, 6) AS median, round(least(1.5, greatest(0.0, log2(pow(a / pow(0.18, 1 - c), 1 / c) / {_rein('a')}))), 6) AS lift, round(c, 6) AS contrast FROM k"
)
def auto_shape(spark, d):
    s = stats.auto_shape(stats.log_histogram(_luma(spark, d)))
    return s.select(*[_r(F.col(c)).alias(c) for c in ("median", "lift", "contrast")])


@query(f"WITH {L_SQL}, o AS (SELECT l, row_number() OVER (ORDER BY l) AS i, count(*) OVER () AS n FROM s) SELECT " + ", ".join(f"min(CASE WHEN i = least(n, floor(n * {f}) + 1) THEN l END) AS {c}" for c, f in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p9999", 0.9999))) + " FROM o")
def scene_percentiles(spark, d):
    return stats.indexed_percentiles(_luma(spark, d), "l", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p9999": 0.9999})


@query(f"WITH {RGB_SQL}, q AS (SELECT flag, {_dot_sql((0.2126, 0.7152, 0.0722))} AS l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c) SELECT flag, round(avg(CASE WHEN l > 0.5 THEN 1 ELSE 0 END), 6) AS over_50, round(avg(CASE WHEN l > 0.8 THEN 1 ELSE 0 END), 6) AS over_80, round(avg(CASE WHEN l > 1.0 THEN 1 ELSE 0 END), 6) AS over_100, round(coalesce(avg(CASE WHEN l > 0.5 AND hi > 1e-6 THEN (hi - lo) / hi END), 0), 6) AS hi_sat FROM q GROUP BY flag")
def scene_metrics(spark, d):
    c = [F.col(x) for x in "rgb"]
    q = _rgb(spark, d).withColumn("l", color.luminance709(*c)).withColumn("sat", color.saturation(*c))
    over = lambda t: _r(F.avg(F.when(F.col("l") > t, 1).otherwise(0)))
    bright = (F.col("l") > 0.5) & (F.greatest(*c) > 1e-6)
    return q.groupBy("flag").agg(over(0.5).alias("over_50"), over(0.8).alias("over_80"), over(1.0).alias("over_100"), _r(F.coalesce(F.avg(F.when(bright, F.col("sat"))), F.lit(0.0))).alias("hi_sat"))


@query(f"WITH {P_SQL}, m AS (SELECT y, x, CASE WHEN l > 0.5 THEN 1 ELSE 0 END AS bright FROM p), k AS (SELECT a.y, a.x, a.bright, (SELECT max(y) FROM m) AS h, sum(b.bright) AS s FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL) SELECT 'plane' AS image_id, CAST(sum(bright) AS BIGINT) AS bright, CAST(sum(CASE WHEN bright = 1 AND x > 0 AND y > 0 AND x < 63 AND y < h AND s - 1 >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS blob FROM k")
def blob_fraction(spark, d):
    return plane.blob_like(_plane(spark, d).select("image_id", "y", "x", (F.col("l") > 0.5).cast("int").alias("bright")))


def _log_plane(spark, d):
    return _plane(spark, d).select("image_id", "y", "x", tone.log_luminance(F.col("l")).alias("v"))


_H = "(SELECT max(vec_id) FROM embeddings)"


def _blur_sql(src, cols, r, out):
    """Padded self-joins, rows then columns; independent of the window form."""
    pick = lambda c: f"avg(s.{c}) AS {c}"
    return (
        f"{out}_h AS (SELECT a.y, a.x, {', '.join(map(pick, cols))} FROM {src} a, range(-{r}, {r} + 1) k(o) JOIN {src} s ON s.y = a.y AND s.x = least(63, greatest(0, a.x + k.o)) GROUP BY a.y, a.x), "
        f"{out} AS (SELECT a.y, a.x, {', '.join(map(pick, cols))} FROM {out}_h a, range(-{r}, {r} + 1) k(o) JOIN {out}_h s ON s.x = a.x AND s.y = least({_H}, greatest(0, a.y + k.o)) GROUP BY a.y, a.x)"
    )


_V = "v AS (SELECT y, x, greatest(-20.0, log2(greatest(l, 1e-7))) AS v FROM p)"


@query(f"WITH {P_SQL}, {_V}, {_blur_sql('v', ['v'], 2, 'w')} SELECT y, round(avg(v), 6) AS v, round(max(v), 6) AS top FROM w GROUP BY y")
def box_blur(spark, d):
    return plane.box_blur(_log_plane(spark, d), 2).groupBy("y").agg(_r(F.avg("v")).alias("v"), _r(F.max("v")).alias("top"))


_G = f"{_V}, v2 AS (SELECT y, x, v AS m, v * v AS s FROM v), {_blur_sql('v2', ['m', 's'], 4, 'g1')}, ab AS (SELECT y, x, greatest(0, s - m * m) / (greatest(0, s - m * m) + 4.0) AS a, m * (1 - greatest(0, s - m * m) / (greatest(0, s - m * m) + 4.0)) AS b FROM g1), {_blur_sql('ab', ['a', 'b'], 4, 'g2')}, f AS (SELECT y, x, a * v + b AS v FROM g2 JOIN v USING (y, x))"


@query(f"WITH {P_SQL}, {_G} SELECT y, round(avg(v), 6) AS v, round(max(v), 6) AS top FROM f GROUP BY y")
def guided_filter(spark, d):
    return plane.guided_filter(_log_plane(spark, d), 4, 4.0).groupBy("y").agg(_r(F.avg("v")).alias("v"), _r(F.max("v")).alias("top"))


def _guide(spark, d, block):
    g = stats.block_means(_plane(spark, d), block, F.col("l"))
    return g.withColumn("v", tone.log_luminance(F.col("v")))


_BASE = (
    "g AS (SELECT y // 4 AS gy, x // 4 AS gx, greatest(-20.0, log2(greatest(avg(l), 1e-7))) AS v FROM p GROUP BY ALL), "
    "z AS (SELECT y, x, l, (y + 0.5) / 4 - 0.5 AS fy, (x + 0.5) / 4 - 0.5 AS fx FROM p), "
    "t AS (SELECT y, x, l, CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END * CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END AS w, "
    "least((SELECT max(gy) FROM g), greatest(0, CAST(floor(fy) AS BIGINT) + dy)) AS gy, least(15, greatest(0, CAST(floor(fx) AS BIGINT) + dx)) AS gx FROM z, range(2) a(dy), range(2) b(dx)), "
    "base AS (SELECT y, x, l, sum(w * v) AS b FROM t JOIN g USING (gy, gx) GROUP BY y, x, l)"
)


@query(f"WITH {P_SQL}, {_BASE} SELECT y, round(avg(b), 6) AS base, round(min(b), 6) AS low FROM base GROUP BY y")
def bilinear_base(spark, d):
    return plane.bilinear(_plane(spark, d), _guide(spark, d, 4), 4).groupBy("y").agg(_r(F.avg("base")).alias("base"), _r(F.min("base")).alias("low"))


def _mapped(spark, d):
    p = plane.bilinear(_plane(spark, d), _guide(spark, d, 4), 4)
    p = p.withColumn("sdr", color.clamp(F.col("l") * tone.local_scale(F.col("l"), F.col("base"), tone.knee_start(2.3), 2.3), 0, 1))
    return p.withColumn("g", tone.gain(F.col("l"), F.col("sdr")))


_K = repr(math.log2(0.8))
_LS = f"({_compress_sql('b', '-1.955', '2.3')} + 1.25 * (greatest(-20.0, log2(greatest(l, 1e-7))) - b))"
_MAP = (
    f"{_BASE}, ls AS (SELECT y, x, l, {_LS} AS q FROM base), "
    f"sd AS (SELECT y, x, l, least(1.0, greatest(0.0, l * least(1.0, pow(2.0, {_compress_sql('q', _K, f'({_K} + 2)')}) / l))) AS sdr FROM ls), "
    "mg AS (SELECT y, x, l, sdr, log2((l + 0.015625) / (sdr + 0.015625)) AS g FROM sd)"
)


@query(f"WITH {P_SQL}, {_MAP} SELECT y, round(avg(sdr), 6) AS sdr, round(avg(g), 6) AS gain FROM mg GROUP BY y")
def local_tonemap(spark, d):
    return _mapped(spark, d).groupBy("y").agg(_r(F.avg("sdr")).alias("sdr"), _r(F.avg("g")).alias("gain"))


_GR = f"{_MAP}, gp AS (SELECT y // 2 AS gy, x // 2 AS gx, avg(g) AS g FROM mg GROUP BY ALL), rg AS (SELECT least(0.0, min(g)) AS lo, greatest(least(0.0, min(g)) + 1e-4, max(g)) AS hi FROM gp)"


@query(f"WITH {P_SQL}, {_GR} SELECT 'plane' AS image_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rg")
def gain_range(spark, d):
    return gain.gain_range(gain.gain_plane(_mapped(spark, d), 2, F.col("g"))).select("image_id", _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


@query(f"WITH {P_SQL}, {_GR} SELECT CAST(gy AS BIGINT) AS gy, round(avg(round(255 * least(1.0, greatest(0.0, (g - lo) / (hi - lo))))), 1) AS q FROM gp, rg GROUP BY gy")
def gain_quantised(spark, d):
    return gain.quantised(gain.gain_plane(_mapped(spark, d), 2, F.col("g"))).groupBy("gy").agg(F.round(F.avg("q"), 1).alias("q"))


@query(f"WITH {P_SQL}, {_MAP}, rg AS (SELECT least(0.0, min(g)) AS lo, greatest(least(0.0, min(g)) + 1e-4, max(g)) AS hi FROM mg), o AS (SELECT l, (sdr + 0.015625) * pow(2.0, lo + (hi - lo) * round(255 * least(1.0, greatest(0.0, (g - lo) / (hi - lo)))) / 255) - 0.015625 AS got FROM mg, rg) SELECT round(avg(CASE WHEN l >= 0.02 THEN abs(got - l) / l END), 4) AS mean_rel, max(CASE WHEN l >= 0.02 THEN abs(got - l) / l END) < 0.15 AS within FROM o")
def gain_roundtrip(spark, d):
    m = _mapped(spark, d).withColumnsRenamed({"y": "gy", "x": "gx"})
    q = gain.quantised(m)
    e = stats.errors(q.withColumn("got", tone.restore(F.col("sdr"), F.col("q"), F.col("lo"), F.col("hi"))), "got", "l")
    return e.select(F.round("mean_rel", 4).alias("mean_rel"), (F.col("max_rel") < 0.15).alias("within"))


_INT = f"i AS (SELECT y, x, CAST(round(255 * least(1.0, greatest(0.0, e + 0.5))) AS INTEGER) AS r, CAST(round(255 * least(1.0, greatest(0.0, 0.5 - e))) AS INTEGER) AS g, (y * 7 + x * 3) % 256 AS b FROM ({E_SQL}))"


def _ints(spark, d):
    p = _plane(spark, d, lambda v: v)
    q = lambda v: F.round(255 * color.clamp(v, 0, 1)).cast("int")
    return p.select("y", "x", q(F.col("l") + 0.5).alias("r"), q(0.5 - F.col("l")).alias("g"), F.pmod(F.col("y") * 7 + F.col("x") * 3, F.lit(256)).cast("int").alias("b"))


@query(f"WITH {_INT}, m AS (SELECT y // 2 AS gy, x // 2 AS gx, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM i GROUP BY ALL) SELECT CAST(gy AS BIGINT) AS gy, CAST(sum(least(255, greatest(0, (-11059 * r - 21709 * g + 32768 * b + 8388608) >> 16))) AS BIGINT) AS cb, CAST(sum(least(255, greatest(0, (32768 * r - 27439 * g - 5329 * b + 8388608) >> 16))) AS BIGINT) AS cr, CAST(sum(least(255, greatest(0, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16))) AS BIGINT) AS luma FROM m GROUP BY gy")
def ycbcr_420(spark, d):
    m = _ints(spark, d).groupBy(F.floor(F.col("y") / 2).alias("gy"), F.floor(F.col("x") / 2).alias("gx")).agg(*[F.expr(f"sum({c}) div count(*)").alias(c) for c in "rgb"])
    y, cb, cr = color.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return m.groupBy("gy").agg(F.sum(cb).alias("cb"), F.sum(cr).alias("cr"), F.sum(y).alias("luma"))


def _cands():
    out = []
    for n in color.PRIMARIES:
        m = color.adaptation(color.D65, color.D50) @ color.to_xyz(n)
        out.append((n, m.T.reshape(-1).tolist()))
    return out


_NP = ", ".join(f"('{n}', {k}, [{', '.join(repr(x) for x in v)}])" for k, (n, v) in enumerate(_cands()))


@query(f"WITH c(name, pos, ref) AS (VALUES {_NP}), q AS (SELECT vec_id, c.name, c.pos, list_sum(list_transform(range(1, 10), lambda i: abs(CAST(embedding[i] AS DOUBLE) * 0.05 + (c2.ref)[i] - c.ref[i]))) AS err FROM embeddings e JOIN c c2 ON c2.pos = e.vec_id % 5, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, pos) AS k FROM q) SELECT vec_id, CASE WHEN err < 0.05 THEN name END AS nearest, round(err, 6) AS err FROM r WHERE k = 1")
def nearest_primaries(spark, d):
    refs = F.array(*[F.array(*[F.lit(x) for x in v]) for _, v in _cands()])
    e = _read(spark, d, "embeddings")
    base = F.element_at(refs, (F.col("vec_id") % 5 + 1).cast("int"))
    made = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.element_at(F.col("embedding"), i).cast("double") * 0.05 + F.element_at(base, i))
    return match.nearest_primaries(e.select("vec_id", made.alias("colorants"))).select("vec_id", "nearest", _r(F.col("err")).alias("err"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM v), q AS (SELECT a.vec_id AS received, b.vec_id AS sent, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-9) AS r FROM c a, c b WHERE b.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY received ORDER BY r DESC, sent) AS n FROM q) SELECT received, sent, round(r, 6) AS r FROM k WHERE n = 1")
def best_match(spark, d):
    """All rows against a stated query set, those whose id is divisible by 100."""
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return match.best_match(e, e.where("id % 100 = 0")).select("received", "sent", _r(F.col("r")).alias("r"))


def _side_sql(s):
    return f"(SELECT lang AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, n_chars || '/' || substr(md5(text), 1, 8) AS e, doc_id FROM documents WHERE source = '{s}')"


@query(f"WITH j AS (SELECT coalesce(a.name, b.name) AS name, a.e AS a, b.e AS b, a.doc_id AS p, b.doc_id AS q FROM {_side_sql('src1')} a FULL OUTER JOIN {_side_sql('src2')} b ON a.name = b.name AND a.n = b.n) SELECT name, count(a) AS a, count(b) AS b, bool_or(a IS DISTINCT FROM b) AS differs, CASE WHEN min(p) IS NULL THEN 1 ELSE 0 END AS side, coalesce(min(p), min(q)) AS place FROM j GROUP BY name")
def segment_diff(spark, d):
    """Two files' segments side by side; the sources src1 and src2 stand in for the two files that are compared."""
    s = _read(spark, d, "documents").select("source", F.col("lang").alias("name"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"), F.substring(F.md5("text"), 1, 8).alias("digest"))
    return match.differences(match.align(s.where("source = 'src1'"), s.where("source = 'src2'")))


@query("SELECT page_id, CASE WHEN a <> '' THEN a ELSE t END AS value, CASE WHEN a <> '' THEN 'attribute' WHEN t <> '' THEN 'element' ELSE 'absent' END AS form FROM (SELECT page_id, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) AS a, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def property_forms(spark, d):
    p = _read(spark, d, "pages").select("page_id", F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("a"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    return p.select("page_id", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("t")).alias("value"), F.when(F.col("a") != "", "attribute").when(F.col("t") != "", "element").otherwise("absent").alias("form"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def report_json(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return _read(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n = 0 THEN source ELSE source || '-' || n END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def unique_names(spark, d):
    return match.unique_names(_read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "name")


@query("SELECT event_type, CASE WHEN g > 1 THEN round(1 / g, 4) ELSE g END AS gamma, count(*) AS n FROM (SELECT event_type, CAST(user_id % 4 + 1 AS DOUBLE) AS g FROM events) GROUP BY ALL")
def preset_migration(spark, d):
    g = F.col("user_id") % 4 + 1.0
    return _read(spark, d, "events").select("event_type", F.when(g > 1, F.round(1 / g, 4)).otherwise(g).alias("gamma")).groupBy("event_type", "gamma").agg(F.count("*").alias("n"))


@query(f"WITH {P_SQL}, b AS (SELECT y // 2 AS gy, x // 2 AS gx, avg(l) AS v FROM p GROUP BY ALL), s AS (SELECT v AS l FROM b), {H_SQL}, {_RUN} SELECT (SELECT round(log2(max(v)), 6) FROM b) AS headroom, (SELECT round({_pct_sql(0.5)}, 6) FROM r) AS median, (SELECT round(sum(CASE WHEN bin > 224 THEN n ELSE 0 END) / sum(n), 6) FROM h) AS above")
def headroom_report(spark, d):
    """Flagship: headroom, and median and share above white of the block means of each image."""
    p = _plane(spark, d)
    h = stats.log_histogram(stats.block_means(p, 2, F.col("l")), "v", ("image_id",))
    q = stats.percentile(h, {"median": 0.5}, ("image_id",)).join(stats.fraction_above(h, 1.0, ("image_id",)), "image_id").join(stats.peaks(p, 2), "image_id")
    return q.select(_r(F.col("headroom")).alias("headroom"), _r(F.col("median")).alias("median"), _r(F.col("above")).alias("above"))


from . import catalog_files, catalog_values  # noqa: E402, F401  (they register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
