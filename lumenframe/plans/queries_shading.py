"""Registered queries: shading, resampling, chromatic shift, detection, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.model import FlatfieldSettings
from lumenframe.operators import chromatic as CH
from lumenframe.operators import detection as DT
from lumenframe.operators import enhance as EN
from lumenframe.operators import image as I
from lumenframe.operators import masks as M
from lumenframe.operators import shading as SH
from lumenframe.operators import thresholds as TH
from lumenframe.plans import denoising as DN
from lumenframe.plans import shading as SP
from lumenframe.plans.catalog import q6, query, r6, with_ctes
from lumenframe.sources import puncta_files as PF
from lumenframe.sources import tables as S

_FIELD = FlatfieldSettings(working_size=S.TILE)


def _tile_voxels(spark, d, stride=S.TILE):
    """Voxels with their tile and in-tile position."""
    t = S.tiles(spark, d).select("*", F.posexplode("px").alias("_i", "v"))
    ly, lx = F.floor(F.col("_i") / S.TILE).cast("int"), (F.col("_i") % S.TILE).cast("int")
    return t.select("c", "z", "ty", "tx", (F.col("ty") * stride + ly).cast("int").alias("y"),
                    (F.col("tx") * stride + lx).cast("int").alias("x"), ly.alias("ly"), lx.alias("lx"), "v")


# ---------------------------------------------------------------------- shading
_FLAT = "(0.8::DOUBLE + 0.4::DOUBLE * ((ly + lx) / 14.0::DOUBLE))"


def _known_field(spark):
    i = spark.range(S.TILE * S.TILE).select(F.floor(F.col("id") / S.TILE).cast("int").alias("y"),
                                            (F.col("id") % S.TILE).cast("int").alias("x"))
    return i.select(F.explode(F.array(*[F.lit(c) for c in (1, 2, 4)])).alias("c"), "y", "x",
                    (0.8 + 0.4 * ((F.col("y") + F.col("x")) / 14.0)).alias("flat"))


@query(with_ctes("img", f"""
    SELECT c, z, CAST(ty * 6 + ly AS INT) y, CAST(tx * 6 + lx AS INT) x,
           CAST(trunc(greatest(0, least(60000, avg(CASE WHEN c NOT IN (1, 2, 4) THEN v::DOUBLE
             WHEN v = 60000 THEN 60000::DOUBLE ELSE v / {_FLAT} END)))) AS INT) v
    FROM img GROUP BY c, z, ty * 6 + ly, tx * 6 + lx"""))
def flatfield_apply(spark, d):
    tiles = SH.correct_tiles(S.tiles(spark, d), _known_field(spark), 60000)
    slot, slots = I.tile_slot(F.floor(F.col("_i") / S.TILE), F.col("_i") % S.TILE, S.TILE, S.TILE, 6)
    out = I.stitch(S.unfold(tiles, 6, slot=slot), slots=slots)
    return out.select("c", "z", "y", "x", I.clip_pixel(F.col("v"), 60000).alias("v"))


@query()
def flatfield(spark, d):
    """Iterative low-rank estimate per channel; checked by fixtures."""
    return SH.estimate_flatfield(S.tiles(spark, d).select("c", "px"), (S.TILE, S.TILE), _FIELD)


@query()
def shading_correction(spark, d):
    field = SH.estimate_flatfield(S.tiles(spark, d).select("c", "px"), (S.TILE, S.TILE), _FIELD)
    return SH.correct_shading(_tile_voxels(spark, d), field, 65535)


@query()
def base_fluorescence(spark, d):
    """Level of every tile of every channel, each channel with its own estimated field."""
    tiles = S.tiles(spark, d)
    fields = SH.estimate_flatfield(tiles.select("c", "px"), (S.TILE, S.TILE), _FIELD)
    return SH.base_fluorescence(tiles, (S.TILE, S.TILE), fields, working_size=S.TILE)


@query(with_ctes("img", """
    SELECT DISTINCT c, z, CAST(ty AS INT) ty, CAST(tx AS INT) tx,
           CAST(floor(trunc((ty * 8 + 8 + ty * 8) / 2.0::DOUBLE - 8 * 0.05::DOUBLE) / 7) AS INT) gy,
           CAST(floor(trunc((tx * 8 + 8 + tx * 8) / 2.0::DOUBLE - 8 * 0.05::DOUBLE) / 7) AS INT) gx FROM img"""))
def grid_cells(spark, d):
    cell = lambda t: SH.grid_cell(F.col(t) * S.TILE, F.col(t) * S.TILE + S.TILE, S.TILE, 0.05)
    return S.tiles(spark, d).select("c", "z", "ty", "tx", cell("ty").alias("gy"), cell("tx").alias("gx"))


# annotated region: a disc around the plane centre
_DISC = {"disc": """SELECT CAST(y AS INT) y, CAST(x AS INT) x FROM range(0, 16) a(y), range(0, 16) b(x)
                    WHERE (y - 6) * (y - 6) + (x - 6) * (x - 6) <= 40""",
         "bg": """SELECT c, z, ty, tx, median(v) FILTER (WHERE k IS NULL) background
                  FROM img LEFT JOIN (SELECT y, x, 1 k FROM disc) USING (y, x)
                  GROUP BY c, z, ty, tx HAVING count(k) / count(*) < 0.9 AND count(*) > count(k)"""}
_TILE_KEY = ["c", "z", "ty", "tx"]


def _disc(spark):
    y, x = F.floor(F.col("id") / S.PLANE).cast("int"), (F.col("id") % S.PLANE).cast("int")
    return (spark.range(S.PLANE * S.PLANE).select(y.alias("y"), x.alias("x"))
            .filter((F.col("y") - 6) * (F.col("y") - 6) + (F.col("x") - 6) * (F.col("x") - 6) <= 40))


@query(with_ctes("img", f"SELECT c, z, ty, tx, {q6('background')} background FROM bg", _DISC))
def background_median(spark, d):
    out = SH.tile_background(_tile_voxels(spark, d), _disc(spark), _TILE_KEY)
    return out.withColumn("background", r6("background"))


@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('CASE WHEN k IS NULL THEN v - coalesce(background, 0) ELSE v END')} v
    FROM img LEFT JOIN (SELECT y, x, 1 k FROM disc) USING (y, x) LEFT JOIN bg USING (c, z, ty, tx)""", _DISC))
def background_subtract(spark, d):
    t, m = _tile_voxels(spark, d), _disc(spark)
    out = SH.subtract_background(t, m, SH.tile_background(t, m, _TILE_KEY), _TILE_KEY)
    return out.select("c", "z", "y", "x", r6("v").alias("v"))


@query()
def background_interpolate(spark, d):
    """Smooth background over the tile grid of every slice; a solve per grid, so no SQL."""
    bg = SH.tile_background(_tile_voxels(spark, d), _disc(spark), _TILE_KEY)
    grid = bg.select("c", "z", F.col("ty").alias("gy"), F.col("tx").alias("gx"), "background")
    wanted = S.tiles(spark, d).select("c", "z", F.col("ty").alias("gy"), F.col("tx").alias("gx"))
    return SH.interpolate_background(grid, wanted, ["c", "z"])


_FULL = {
    "disc": _DISC["disc"],
    "t": f"""SELECT c, z, ty, tx, CAST(ty * 6 + ly AS INT) y, CAST(tx * 6 + lx AS INT) x,
                    (CASE WHEN c = 3 THEN 65535 - v ELSE v END - {{dark}}) / {{flat}} v FROM img""",
    "m": "SELECT t.*, k FROM t LEFT JOIN (SELECT y, x, 1 k FROM disc) USING (y, x)",
    "b": """SELECT c, z, ty, tx, median(v) FILTER (WHERE k IS NULL) background FROM m WHERE c IN (2, 3)
            GROUP BY c, z, ty, tx HAVING count(k) / count(*) < 0.9 AND count(*) > count(k)""",
}
_FULL["t"] = _FULL["t"].format(dark="CASE WHEN c IN (1, 2, 4) THEN 500.0::DOUBLE + ly ELSE 0 END",
                               flat=f"CASE WHEN c IN (1, 2, 4) THEN {_FLAT} ELSE 1 END")


def _full(spark, d, method, **more):
    field = _known_field(spark).withColumn("dark", 500.0 + F.col("y"))
    return SP.full_correction(S.tiles(spark, d), field, S.TILE, 6, 65535, invert=[3], background=[2, 3], method=method,
                              mask=_disc(spark), **more)


@query(with_ctes("img", """
    SELECT c, z, y, x, CASE WHEN c <> 3 THEN v WHEN v = 0 THEN 0 ELSE 65535 - v END v
    FROM (SELECT c, z, y, x, CAST(trunc(greatest(0, least(65535, avg(v - CASE WHEN k IS NULL THEN coalesce(background, 0) ELSE 0 END)))) AS INT) v
          FROM m LEFT JOIN b USING (c, z, ty, tx) GROUP BY c, z, y, x)""", _FULL))
def full_correction(spark, d):
    """Dark field, flat field, background from an annotated region, inversion, stitching."""
    return _full(spark, d, "annotation")


@query(with_ctes("img", """
    SELECT c, z, y, x, CASE WHEN c <> 3 THEN v WHEN v = 0 THEN 0 ELSE 65535 - v END v
    FROM (SELECT c, z, y, x, CAST(trunc(greatest(0, least(65535, avg(v - CASE WHEN c IN (2, 3) THEN 1000 + ty ELSE 0 END)))) AS INT) v
          FROM t GROUP BY c, z, y, x)""", {"t": _FULL["t"]}))
def full_correction_base(spark, d):
    """The same with a given level per tile."""
    base = S.tiles(spark, d).select("c", "z", "ty", "tx", (1000.0 + F.col("ty")).alias("base"))
    return _full(spark, d, "base", base=base)


# --------------------------------------------- adaptive equalisation, entry flow
def _adaptive(source: str, size: int, k: int, limit: int, top: int = 65535) -> dict[str, str]:
    """CTEs that equalise images (c, z, y, x, v) of ``source``; the last one is ``eq``. Tiles are k x k."""
    pad, n = -size % k, -(-size // k)
    mirror = lambda p: (f"CASE j WHEN 0 THEN {p} ELSE CASE WHEN {p} < {size - 1} AND {2 * (size - 1)} - {p} < {size + pad} "  # noqa: E731
                        f"THEN {2 * (size - 1)} - {p} END END")
    near = "greatest(0, least({n}, (p{a} // {k}) - 1 + {d}))"
    lut = lambda dy, dx: (f"(SELECT lut FROM eq_lut t WHERE t.c = p.c AND t.z = p.z AND t.ty = {near.format(n=n - 1, a='y', k=k, d=dy)} "  # noqa: E731
                          f"AND t.tx = {near.format(n=n - 1, a='x', k=k, d=dx)})[bin + 1]::DOUBLE")
    return {
        "eq_ends": f"SELECT c, z, min(v) lo, max(v) hi FROM {source} GROUP BY c, z",
        "eq_bin": f"""SELECT c, z, y, x, v, lo = hi flat, CAST(CASE WHEN hi > lo THEN CAST(round_even((v - lo)::DOUBLE / (hi - lo) * 16383.0::DOUBLE, 0) AS BIGINT) // 65 ELSE 0 END AS INT) bin
                      FROM {source} JOIN eq_ends USING (c, z)""",
        "eq_pad": f"""SELECT c, z, bin, yy // {k} ty, xx // {k} tx FROM (SELECT c, z, x, bin, {mirror('y')} yy FROM eq_bin, range(0, 2) r(j)) a,
                      LATERAL (SELECT {mirror('x')} xx FROM range(0, 2) r(j)) b WHERE yy IS NOT NULL AND xx IS NOT NULL""",
        "eq_hist": """SELECT c, z, ty, tx, list_transform(range(0, 256), lambda b: coalesce(map_extract(m, b)[1], 0)) h
                      FROM (SELECT c, z, ty, tx, map(list(bin), list(n)) m FROM (
                            SELECT c, z, ty, tx, bin::BIGINT bin, count(*) n FROM eq_pad GROUP BY ALL) GROUP BY ALL)""",
        "eq_cut": f"""SELECT c, z, ty, tx, list_transform(h, lambda a: least(a, {limit})) h,
                             CAST(list_sum(list_transform(h, lambda a: greatest(a - {limit}, 0))) AS BIGINT) s FROM eq_hist""",
        "eq_share": f"""SELECT c, z, ty, tx, list_transform(h, lambda a: CASE WHEN a < {limit} - s // 256 THEN a + s // 256 ELSE {limit} END) f, h, s FROM eq_cut""",
        "eq_deal": f"""SELECT c, z, ty, tx, f, CAST(s - (list_sum(f) - list_sum(h)) AS BIGINT) rest, 0 i FROM eq_share
                       UNION ALL
                       SELECT c, z, ty, tx, g, CAST(rest - (list_sum(g) - list_sum(f)) AS BIGINT), i + 1 FROM (
                         SELECT *, list_transform(f, lambda a, b: CASE WHEN b - 1 >= i % 256 AND (b - 1 - i % 256) % step = 0 AND a < {limit} THEN a + 1 ELSE a END) g
                         FROM (SELECT *, greatest(1, len(list_filter(f, lambda a: a < {limit})) // rest) step FROM eq_deal WHERE rest > 0))""",
        "eq_lut": f"""SELECT c, z, ty, tx, list_transform(range(1, 257), lambda b: CAST(trunc(least(16383, list_sum(f[1:b]) * (16383.0::DOUBLE / {k * k}))) AS INT)) lut
                      FROM eq_deal WHERE rest <= 0""",
        "eq_mix": f"""SELECT c, z, y, x, v, flat, floor(({lut(0, 0)} * (1 - fx) + {lut(0, 1)} * fx) * (1 - fy) + ({lut(1, 0)} * (1 - fx) + {lut(1, 1)} * fx) * fy + 1e-6) e
                      FROM (SELECT *, y + {k // 2} py, x + {k // 2} px, ((y + {k // 2}) % {k}) / {k}::DOUBLE fy, ((x + {k // 2}) % {k}) / {k}::DOUBLE fx FROM eq_bin) p""",
        "eq": f"""SELECT c, z, y, x, CAST(CASE WHEN flat THEN v ELSE floor((e - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * {top} + 1e-6) END AS INT) v
                  FROM eq_mix JOIN (SELECT c, z, min(e) lo, max(e) hi FROM eq_mix GROUP BY c, z) USING (c, z)""",
    }


@query(with_ctes("img", "SELECT c, z, y, x, v FROM eq", _adaptive("img", 16, 8, 3), recursive=True))
def adaptive_equalize(spark, d):
    """Every slice by tiles of 8 x 8 pixels, three of which may share a bin."""
    return EN.equalize_adaptive(S.voxels(spark, d).select("c", "z", "y", "x", "v"), S.PLANE, S.PLANE, 65535, 0.05, (8, 8))


_CLIPPED = """SELECT c, z, y, x, CAST(trunc(greatest(0, least(65535, avg(v - CASE WHEN k IS NULL THEN coalesce(background, 0) ELSE 0 END)))) AS INT) v
              FROM m LEFT JOIN b USING (c, z, ty, tx) GROUP BY c, z, y, x"""
_NORMAL = {**_FULL, "clipped": _CLIPPED, "chosen": "SELECT * FROM clipped WHERE c IN (3, 5)", **_adaptive("chosen", 14, 5, 2)}


@query(with_ctes("img", """
    SELECT c, z, y, x, CASE WHEN c <> 3 THEN v WHEN v = 0 THEN 0 ELSE 65535 - v END v
    FROM (SELECT * FROM eq UNION ALL SELECT c, z, y, x, v FROM clipped WHERE c NOT IN (3, 5))""", _NORMAL, recursive=True))
def full_correction_normalized(spark, d):
    """The full correction with the intensities of an inverted and of a plain channel equalised."""
    return _full(spark, d, "annotation", normalize=[3, 5], clip_limit=0.1, kernel=(5, 5), shape=(14, 14))


@query()
def full_correction_interpolated(spark, d):
    """The full correction with the background interpolated over the grid of tiles; a solve per grid, so no SQL."""
    return _full(spark, d, "annotation_interpolate")


_ENTRY_W = """CASE WHEN t <= 1 THEN 1.25::DOUBLE * t * t * t - 2.25::DOUBLE * t * t + 1
              WHEN t < 2 THEN -0.75::DOUBLE * (t * t * t - 5 * t * t + 8 * t - 4) ELSE 0 END"""
_ENTRY = {
    "w": f"""SELECT i, o, {_ENTRY_W} w FROM (SELECT i, o, abs((o + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5 - i) t FROM range(0, 4) a(i), range(0, 8) b(o))""",
    "wn": "SELECT i, o, w / sum(w) OVER (PARTITION BY o) w FROM w",
    "field": """SELECT a.o ly, b.o lx, sum((0.731::DOUBLE + 0.0917::DOUBLE * a.i + 0.0531::DOUBLE * b.i) * a.w * b.w) flat FROM wn a, wn b GROUP BY a.o, b.o""",
}


@query(with_ctes("img", """
    SELECT c, z, CAST(ty * 6 + ly AS INT) y, CAST(tx * 6 + lx AS INT) x,
           CAST(trunc(greatest(0, least(65535, avg(CASE WHEN c = 3 OR v = 65535 THEN v::DOUBLE ELSE v / flat END)))) AS INT) v
    FROM img JOIN field USING (ly, lx) GROUP BY c, z, ty * 6 + ly, tx * 6 + lx""", _ENTRY))
def entry_correction(spark, d):
    """The entry flow with a given field of half the tile's size, channel 3 left alone."""
    cells = spark.range(16).select(F.explode(F.array(*[F.lit(c) for c in (1, 2, 4, 5)])).alias("c"), F.floor(F.col("id") / 4).cast("int").alias("y"),
                                   (F.col("id") % 4).cast("int").alias("x"))
    field = cells.withColumn("flat", 0.731 + 0.0917 * F.col("y") + 0.0531 * F.col("x"))
    return SP.entry_correction(S.tiles(spark, d), (S.TILE, S.TILE), 6, 65535, channels=[1, 2, 4, 5], ratio=2, field=field)


@query()
def entry_flow(spark, d):
    """The entry flow with the field fitted to decimated tiles; the fit is iterative, so no SQL."""
    return SP.entry_correction(S.tiles(spark, d), (S.TILE, S.TILE), 6, 65535, channels=[1, 2, 4, 5], ratio=2)


# ------------------------------------------------------------------- resampling
def _lin(axis, step, stretch):
    return f"greatest(0, 1 - abs(((o + 0.5::DOUBLE) * {step} - 0.5 - {axis}) / {stretch}))"


@query(with_ctes("img", f"""
    SELECT c, z, CAST(y AS INT) y, CAST(o AS INT) x, {q6(f"sum(v * {_lin('x', '(16::DOUBLE/24)', '1.0::DOUBLE')}) / sum({_lin('x', '(16::DOUBLE/24)', '1.0::DOUBLE')})")} v
    FROM (SELECT c, z, o y, x, sum(v * w) / sum(w) v FROM (
            SELECT c, z, o, x, v, {_lin('y', '(16::DOUBLE/6)', '(16::DOUBLE/6)')} w FROM img, range(0, 6) r(o)) GROUP BY ALL) t,
         range(0, 24) r(o) WHERE {_lin('x', '(16::DOUBLE/24)', '1.0::DOUBLE')} > 0 GROUP BY c, z, y, o"""))
def resize_linear(spark, d):
    return I.resize(S.voxels(spark, d), {"y": (16, 6), "x": (16, 24)}).withColumn("v", r6("v"))


_CUBIC = """CASE WHEN t <= 1 THEN 1.5::DOUBLE * t * t * t - 2.5::DOUBLE * t * t + 1
            WHEN t < 2 THEN -0.5::DOUBLE * (t * t * t - 5 * t * t + 8 * t - 4) ELSE 0 END"""


@query(with_ctes("img", f"""
    SELECT c, z, y, CAST(o AS INT) x, {q6('sum(v * w) / sum(w)')} v
    FROM (SELECT *, {_CUBIC} w FROM (SELECT c, z, y, o, v, abs((o + 0.5::DOUBLE) * 0.8::DOUBLE - 0.5 - x) t FROM img, range(0, 20) r(o)))
    GROUP BY c, z, y, o"""))
def resize_cubic(spark, d):
    return I.resize(S.voxels(spark, d), {"x": (16, 20)}, "cubic").withColumn("v", r6("v"))


_A = ((1.0, 0.0, 0.0), (0.0, 1.02, 0.01), (0.0, -0.03, 0.97))
_T = (0.25, -0.4, 0.6)


@query(with_ctes("img info", f"""
    SELECT o.z, o.y, o.x, {q6('coalesce(sum(m.v * greatest(0, 1 - abs(sz - m.z)) * greatest(0, 1 - abs(sy - m.y)) * greatest(0, 1 - abs(sx - m.x))), 0)')} v
    FROM (SELECT z, y, x, z + 0.25::DOUBLE sz, 1.02::DOUBLE * y + 0.01::DOUBLE * x - 0.4::DOUBLE sy,
                 -0.03::DOUBLE * y + 0.97::DOUBLE * x + 0.6::DOUBLE sx FROM img WHERE c = 4) o CROSS JOIN info
    LEFT JOIN (SELECT z, y, x, v FROM img WHERE c = 4) m
      ON m.z BETWEEN floor(sz) AND floor(sz) + 1 AND m.y BETWEEN floor(sy) AND floor(sy) + 1
     AND m.x BETWEEN floor(sx) AND floor(sx) + 1
     AND sz >= 0 AND sz <= depth - 1 AND sy >= 0 AND sy <= 15 AND sx >= 0 AND sx <= 15
    GROUP BY o.z, o.y, o.x"""))
def chromatic_warp(spark, d):
    moved = CH.warp(S.voxels(spark, d).filter("c = 4"), S.image_info(spark, d), _A, _T)
    return moved.withColumn("v", r6("v"))


@query(with_ctes("img info", """
    SELECT c, z, y, x, v::DOUBLE v FROM img WHERE c <> 4 UNION ALL
    SELECT 4 c, o.z, o.y, o.x, floor((coalesce(sum(m.v * greatest(0, 1 - abs(sz - m.z)) * greatest(0, 1 - abs(sy - m.y)) * greatest(0, 1 - abs(sx - m.x))), 0)) * 1e6 + 0.5) / 1e6 v
    FROM (SELECT z, y, x, z + 0.25::DOUBLE sz, 1.02::DOUBLE * y + 0.01::DOUBLE * x - 0.4::DOUBLE sy,
                 -0.03::DOUBLE * y + 0.97::DOUBLE * x + 0.6::DOUBLE sx FROM img WHERE c = 4) o CROSS JOIN info
    LEFT JOIN (SELECT z, y, x, v FROM img WHERE c = 4) m
      ON m.z BETWEEN floor(sz) AND floor(sz) + 1 AND m.y BETWEEN floor(sy) AND floor(sy) + 1
     AND m.x BETWEEN floor(sx) AND floor(sx) + 1
     AND sz >= 0 AND sz <= depth - 1 AND sy >= 0 AND sy <= 15 AND sx >= 0 AND sx <= 15
    GROUP BY o.z, o.y, o.x"""))
def chromatic_correct(spark, d):
    """The whole image with one channel warped, before pixels are cut to integers (sums of equal terms differ in the last bit)."""
    out = CH.correct_channel(S.voxels(spark, d), S.image_info(spark, d), 4, _A, _T, integer=False)
    return out.withColumn("v", r6(F.col("v").cast("double")))


# ---------------------------------------------------------- detection and export
_DET = {
    "m": """SELECT z, y, x, v FROM img JOIN (SELECT quantile_cont(v, 0.9) thr FROM img WHERE c = 4) ON v > thr WHERE c = 4""",
    "reach": """SELECT z, y, x, z::HUGEINT * 18446744073709551616 + y * 4294967296 + x AS code FROM m
                UNION SELECT b.z, b.y, b.x, a.code FROM reach a JOIN m b
                ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1""",
    "lab": "SELECT z, y, x, min(code) label FROM reach GROUP BY z, y, x",
}


def _mask4(spark, d):
    v = S.voxels(spark, d).filter("c = 4")
    return M.above_threshold(v, TH.percentile_threshold(v, 90.0)).select("z", "y", "x", "v")


@query(with_ctes("img", f"""
    SELECT CAST(label AS VARCHAR) punctum_id, {q6('sum(x * v::DOUBLE) / sum(v)')} x, {q6('sum(y * v::DOUBLE) / sum(v)')} y,
           {q6('sum(z * v::DOUBLE) / sum(v)')} z, {q6('avg(v) / max(v)')} score,
           {q6('cbrt(count(*) * 3.0::DOUBLE / (4.0::DOUBLE * pi()))')} radius, count(*) vol_size, sum(v)::DOUBLE mass,
           {q6('avg(v)')} mean_intensity, max(v)::DOUBLE max_intensity, {q6('stddev_pop(v)')} sd_intensity,
           CAST(count(*) AS INT) n_voxels, min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max
    FROM lab JOIN m USING (z, y, x) GROUP BY label HAVING count(*) >= 6""", _DET, recursive=True))
def detect_puncta(spark, d):
    out = DT.detect(_mask4(spark, d), block=8).withColumn("punctum_id", F.col("punctum_id").cast("string"))
    return out.withColumns({c: r6(c) for c in ("x", "y", "z", "score", "radius", "mean_intensity", "sd_intensity")})


def _full_puncta(spark, d):
    """Puncta with every measure, derived from events and their users' activity."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "value")
    stats = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("vol_size"), r6(F.avg("value")).alias("mean_intensity"),
        F.max("value").alias("max_intensity"), r6(F.stddev_pop("value")).alias("sd_intensity"))
    p = spark.read.parquet(f"{d}/events.parquet").select(
        "user_id", F.col("event_id").alias("punctum_id"), (F.col("user_id") % S.PLANE).cast("double").alias("x"),
        (F.col("event_id") % S.PLANE).cast("double").alias("y"),
        (F.floor(F.col("event_id") / S.PLANE) % S.PUNCTA_DEPTH).cast("double").alias("z"), F.col("value").alias("mass"))
    return p.join(stats, "user_id").withColumns({
        "score": F.col("mass") / 500.0, "radius": F.sqrt(F.col("vol_size").cast("double"))})


@query(f"""
    SELECT event_id + 1 "puncta #", {q6('value / 500.0')} score, (user_id % 16)::DOUBLE "punctum x",
           (event_id % 16)::DOUBLE "punctum y", ((event_id // 16) % 30)::DOUBLE "punctum z",
           {q6('sqrt(n::DOUBLE)')} radius, n volume, value mass, m "mean intensity", x "max intensity", s "intensity SD"
    FROM events JOIN (SELECT user_id, count(*) n, {q6('avg(value)')} m, max(value) x, {q6('stddev_pop(value)')} s
                      FROM events GROUP BY user_id) USING (user_id)""")
def puncta_info(spark, d):
    return PF.puncta_info(_full_puncta(spark, d)).withColumns({"score": r6("score"), "radius": r6("radius")})


_NAMES = """
    SELECT event_type folder, 'img' || (user_id % 40) || '.tif' image,
           'img' || CASE WHEN event_id % 11 < 9 THEN user_id % 40 + 100 ELSE user_id % 40 END || '_' || event_id ||
           CASE event_id % 7 WHEN 0 THEN '_detected_puncta.nimp' WHEN 1 THEN '_soma_puncta.nimp'
             WHEN 2 THEN '_filtered_puncta.nimp' WHEN 3 THEN '_Assignment.nimp' WHEN 4 THEN '_puncta.csv'
             WHEN 5 THEN '_detected_puncta.nimp' ELSE '_other.nimp' END AS name FROM events"""


def _names(spark, d):
    e, u = F.col("event_id"), F.col("user_id") % 40
    ends = ["_detected_puncta.nimp", "_soma_puncta.nimp", "_filtered_puncta.nimp", "_Assignment.nimp",
            "_puncta.csv", "_detected_puncta.nimp", "_other.nimp"]
    stem = F.when(e % 11 < 9, u + 100).otherwise(u).cast("string")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_type").alias("folder"), F.concat(F.lit("img"), u.cast("string"), F.lit(".tif")).alias("image"),
        F.concat(F.lit("img"), stem, F.lit("_"), e.cast("string"),
                 F.get(F.array(*map(F.lit, ends)), (e % 7).cast("int"))).alias("name"))


@query(f"""
    WITH n AS ({_NAMES}),
    ok AS (SELECT *, contains(name, replace(image, '.tif', '')) hit FROM n WHERE name LIKE '%.nimp'
           AND NOT contains(lower(name), '_filtered_puncta.nimp')
           AND (name LIKE '%\\_detected\\_puncta.nimp' ESCAPE '\\' OR name LIKE '%\\_soma\\_puncta.nimp' ESCAPE '\\'
                OR name LIKE '%\\_puncta.nimp' ESCAPE '\\' OR contains(lower(name), 'assign')))
    SELECT folder, image, name FROM (SELECT *, bool_or(hit) OVER (PARTITION BY folder, image) any_hit FROM ok)
    WHERE hit OR NOT any_hit""")
def puncta_file_choice(spark, d):
    return PF.choose_files(_names(spark, d))


@query(f"""
    WITH n AS ({_NAMES})
    SELECT folder, image, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY name) - 1 AS INT) z FROM n""")
def file_order(spark, d):
    return PF.frame_order(_names(spark, d))


# ---------------------------------------------------------------- slice recovery
@query()
def slice_enhancement(spark, d):
    """Scale, pad, equalise, match and rescale: parts are checked one by one in SQL."""
    v = S.voxels(spark, d)
    return DN.enhance(v, S.image_info(spark, d), S.PLANE, S.PLANE, 3, (1, 20), clip=40.0, grid=(5, 5), channels=range(1, 6))


@query(with_ctes("img", f"""
    SELECT a.slot, a.c, CAST(a.py AS INT) py, CAST(a.px AS INT) px, a.y, a.x, a.z z_clean, b.z z_noisy, a.v clean, b.v noisy
    FROM pa a JOIN pa b ON b.kind = 2 AND b.slot = a.slot AND b.c = a.c AND b.py = a.py AND b.px = a.px AND b.y = a.y AND b.x = a.x
    WHERE a.kind = 1""", {"pa": """
    SELECT kind, slot, c, z, py, px, CAST(i.y - oy AS INT) y, CAST(i.x - ox AS INT) x, v
    FROM img i JOIN (VALUES (1, 0, 4), (1, 1, 7), (2, 0, 9), (2, 1, 2)) k(kind, slot, zz) ON i.z = zz
    JOIN (VALUES (0, 0), (1, 6), (2, 10)) a(py, oy) ON i.y >= oy AND i.y < oy + 6
    JOIN (VALUES (0, 0), (1, 6), (2, 10)) b(px, ox) ON i.x >= ox AND i.x < ox + 6"""}))
def training_pairs(spark, d):
    return DN.training_pairs(S.voxels(spark, d), [4, 7], [9, 2], S.PLANE, S.PLANE, 6)
