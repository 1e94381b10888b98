"""Registered queries: image, threshold, frame and mask operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import frames as FR
from lumenframe.operators import image as I
from lumenframe.operators import masks as M
from lumenframe.operators import thresholds as TH
from lumenframe.operators.relational import attach
from lumenframe.plans.catalog import q6, query, r6, with_ctes
from lumenframe.sources import tables as S

CHANNELS = range(1, 6)


def _mask(spark, d):
    v = S.voxels(spark, d)
    return M.above_threshold(v, TH.percentile_threshold(v))


# ------------------------------------------------------------------- selection
@query(with_ctes("img", "SELECT c, z, y, x, v FROM img WHERE c = 2"))
def channel_split(spark, d):
    return I.channel_split(S.voxels(spark, d), 2)


@query(with_ctes("img", "SELECT c, z, y, x, v FROM img WHERE c NOT IN (2, 4)"))
def channel_exclude(spark, d):
    return I.exclude_channels(S.voxels(spark, d), [2, 4])


@query(with_ctes("img", """
    SELECT CAST(dense_rank() OVER (ORDER BY name) AS INT) c, z, y, x, v
    FROM img JOIN (VALUES (1, 's_ch2'), (2, 's_ch1'), (3, 's_ch3'), (4, 's_ch7'), (5, 's_ch10')) n(ch, name) ON c = ch"""))
def merge_channels(spark, d):
    v = S.voxels(spark, d)
    return I.merge_channels({f"s_ch{n}": I.channel_split(v, c) for c, n in ((1, 2), (2, 1), (3, 3), (4, 7), (5, 10))})


@query(with_ctes("img", """
    SELECT c, z, y, x, v FROM img
    WHERE x >= 3 AND x < 11 AND y >= 5 AND y < 16 AND z >= 2 AND z < 20 AND c >= 2 AND c < 5"""))
def region_scan(spark, d):
    return I.region(S.voxels(spark, d), x=(3, 11), y=(5, 16), z=(2, 20), c=(2, 5))


@query(with_ctes("img", "SELECT c, z, y, x, v FROM img WHERE z > 3 AND z < 12"))
def slices_between(spark, d):
    return I.slices_between(S.voxels(spark, d), 3, 12)


@query(with_ctes("img", """
    SELECT CAST(slot AS INT) slot, c, z, y, x, v
    FROM img JOIN (VALUES (0, 7), (1, 2), (2, 7), (3, 11)) s(slot, zz) ON z = zz"""))
def slice_list(spark, d):
    return I.take_slices(S.voxels(spark, d), [7, 2, 7, 11])


# ------------------------------------------------------------------ tile access
@query(with_ctes("img", f"""
    SELECT c, z, CAST(y // 4 AS INT) y, CAST(x // 4 AS INT) x, {q6('avg(v)')} v
    FROM img GROUP BY ALL"""))
def decimate(spark, d):
    return I.decimate(S.voxels(spark, d), 4, 4).withColumn("v", r6("v"))


@query(with_ctes("img", f"""
    SELECT c, z, CAST(ty * 6 + ly AS INT) y, CAST(tx * 6 + lx AS INT) x,
           {q6('avg(v)')} v, count(*) coverage FROM img GROUP BY c, z, ty * 6 + ly, tx * 6 + lx"""))
def stitch_tiles(spark, d):
    return I.stitch(S.unfold(S.tiles(spark, d), stride=6)).withColumn("v", r6("v"))


@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('coalesce(avg(v), 0)')} v, count(v) coverage
    FROM (SELECT CAST(c AS INT) c, CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x
          FROM range(1, 6) a(c), range(0, (SELECT max(z) + 1 FROM img)) b(z),
               range(0, 17) e(y), range(0, 17) f(x)) g
    LEFT JOIN (SELECT c, z, ty * 9 + ly y, tx * 9 + lx x, v FROM img) t USING (c, z, y, x)
    GROUP BY ALL"""))
def stitch_with_gaps(spark, d):
    info = S.image_info(spark, d).select("depth", F.lit(17).alias("height"), F.lit(17).alias("width"))
    s = I.stitch(S.unfold(S.tiles(spark, d), stride=9))
    return I.fill_uncovered(s, CHANNELS, info).withColumn("v", r6("v"))


@query(f"""
    SELECT l_linenumber c, CAST(0 AS INT) z, CAST(l_orderkey % 64 AS INT) y,
           CAST(l_partkey % 64 AS INT) x, {q6('avg(l_quantity)')} v, count(*) coverage
    FROM lineitem GROUP BY ALL""")
def stitch_bag(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_linenumber").alias("c"), F.lit(0).alias("z"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"),
        (F.col("l_partkey") % 64).cast("int").alias("x"), F.col("l_quantity").alias("v"))
    return I.stitch(li).withColumn("v", r6("v"))


@query(with_ctes("img", """
    SELECT c, z, y, x, v, CASE WHEN v = (SELECT max(v) FROM img) THEN CAST(v AS DOUBLE) ELSE v * 0.5 END corrected
    FROM img"""))
def saturate_correct(spark, d):
    v = S.voxels(spark, d)
    top = v.agg(F.max("v").alias("top"))
    return (attach(v, top, [])
            .withColumn("corrected", F.when(F.col("v") == F.col("top"), F.col("top").cast("double"))
                        .otherwise(F.col("v") * 0.5)).drop("top"))


# ---------------------------------------------------------------------- scaling
@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('CASE WHEN m > 255 THEN v / m * 255 ELSE v END')} v
    FROM img, (SELECT max(v)::DOUBLE m FROM img)"""))
def global_scale(spark, d):
    return I.global_scale(S.voxels(spark, d)).withColumn("v", r6("v"))


@query(with_ctes("img", """
    SELECT c, z, y, x, CAST(trunc(255.0::DOUBLE * (v / m::DOUBLE)) AS INT) v
    FROM img JOIN (SELECT c, z, max(v) m FROM img GROUP BY c, z) USING (c, z)"""))
def frame_scale(spark, d):
    return I.frame_scale(S.voxels(spark, d))


@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('v8 / 255.0 * 2 - 1')} signed_unit,
           {q6('((v8 / 255.0 * 2 - 1) + 1) * 0.5 * 255')} back,
           CAST(trunc(least(65535, greatest(0, v8 * (65535.0::DOUBLE / 255.0)))) AS INT) wide
    FROM (SELECT c, z, y, x, CAST(v // 257 AS INT)::DOUBLE v8 FROM img)"""))
def pixel_ranges(spark, d):
    v8 = F.floor(F.col("v") / 257).cast("double")
    return S.voxels(spark, d).select(
        "c", "z", "y", "x", r6(I.to_signed_unit(v8)).alias("signed_unit"),
        r6(I.from_signed_unit(I.to_signed_unit(v8))).alias("back"), I.widen_to_uint16(v8).alias("wide"))


@query(with_ctes("img", f"""
    SELECT c, count(*) n, {q6('avg(v)')} mean, {q6('stddev_pop(v)')} sd, min(v) lo, max(v) hi,
           count(DISTINCT z) zcount, {q6('count(*) / (SELECT greatest(count(*), 1) FROM img)')} share
    FROM img GROUP BY c"""))
def channel_stats(spark, d):
    v = S.voxels(spark, d)
    stats = v.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("z").alias("zcount"))
    total = v.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return attach(stats, total, []).withColumn("share", r6(F.col("n") / F.col("total"))).drop("total")


@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('(v - mean) / sd')} standard, {q6('(v - mean) / sd * sd + mean')} back
    FROM img JOIN (SELECT c, avg(v) mean, stddev_pop(v) sd FROM img GROUP BY c) USING (c)"""))
def standardize(spark, d):
    v = S.voxels(spark, d)
    s = v.groupBy("c").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    std = I.standardize(F.col("v"), F.col("mean"), F.col("sd"))
    return attach(v, s, ["c"]).select(
        "c", "z", "y", "x", r6(std).alias("standard"),
        r6(I.unstandardize(std, F.col("mean"), F.col("sd"))).alias("back"))


_STRETCH = """
    SELECT c, z, y, x, CAST(trunc(greatest(0, least(1, (v - lo) / (hi - lo))) * 255) AS INT) v
    FROM img JOIN (SELECT c, {lo} lo, {hi} hi FROM img GROUP BY c) USING (c)"""


@query(with_ctes("img", _STRETCH.format(
    lo="quantile_cont(v, 0.02) FILTER (WHERE v > 0)", hi="quantile_cont(v, 0.98) FILTER (WHERE v > 0)")))
def percentile_stretch(spark, d):
    return I.stretch(S.voxels(spark, d))


@query(with_ctes("img", _STRETCH.format(lo="min(v)::DOUBLE", hi="max(v)::DOUBLE")))
def minmax_stretch(spark, d):
    return I.stretch(S.voxels(spark, d), 0, 100)


COLORS = {1: (255, 0, 0), 2: (0, 255, 0), 3: (0, 0, 255), 4: (255, 255, 0), 5: (128, 64, 32)}


@query(with_ctes("img", """
    SELECT z, y, x, max(CAST(trunc(r * norm) AS INT)) r, max(CAST(trunc(g * norm) AS INT)) g,
           max(CAST(trunc(b * norm) AS INT)) b
    FROM (SELECT i.*, (v - lo) / (hi - lo) norm FROM img i, (SELECT min(v)::DOUBLE lo, max(v)::DOUBLE hi FROM img))
    JOIN (VALUES (1,255,0,0),(2,0,255,0),(3,0,0,255),(4,255,255,0),(5,128,64,32)) k(ch,r,g,b) ON c = ch
    GROUP BY z, y, x"""))
def rgb_max(spark, d):
    return I.rgb_composite(S.voxels(spark, d), COLORS)


@query(with_ctes("img", """
    SELECT z, y, x, max(v) FILTER (WHERE c = 1) p1, max(v) FILTER (WHERE c = 3) p3, max(v) FILTER (WHERE c = 5) p5
    FROM img WHERE c IN (1, 3, 5) GROUP BY z, y, x"""))
def channels_last(spark, d):
    hwc = I.channels_last(S.voxels(spark, d), [1, 3, 5])
    return hwc.select("z", "y", "x", *[F.get("px", F.lit(i)).alias(f"p{c}") for i, c in enumerate((1, 3, 5))])


@query(with_ctes("img", """
    SELECT c, z, y, x, 65535 - v plain, 255 - CASE WHEN v8 = 0 THEN 255 ELSE v8 END restored
    FROM (SELECT c, z, y, x, v, CAST(greatest(0, (v - 30000) // 64) % 256 AS INT) v8 FROM img)"""))
def invert(spark, d):
    v8 = (F.floor(F.greatest(F.lit(0), F.col("v") - 30000) / 64) % 256).cast("int")
    return S.voxels(spark, d).select(
        "c", "z", "y", "x", I.invert(F.col("v"), 65535).alias("plain"),
        I.invert(v8, 255, restore_zeros=True).alias("restored"))


# --------------------------------------------------------------------- geometry
@query(with_ctes("img", """
    SELECT CAST(c AS INT) c, CAST(z AS INT) z, CAST(y AS INT) y, CAST(x AS INT) x, coalesce(v, 0) v
    FROM range(1, 6) a(c) CROSS JOIN range(0, (SELECT max(z) + 1 FROM img)) b(z)
    CROSS JOIN range(0, 20) e(y) CROSS JOIN range(0, 20) f(x) LEFT JOIN img USING (c, z, y, x)"""))
def pad4(spark, d):
    return I.pad_to_multiple(S.voxels(spark, d), S.image_info(spark, d), CHANNELS)


@query(with_ctes("img", """
    SELECT CAST(g.c AS INT) c, CAST(g.z AS INT) z, CAST(g.y AS INT) y, CAST(g.x AS INT) x, coalesce(i.v, 0) v
    FROM (SELECT * FROM range(1, 6) a(c), range(0, (SELECT max(z) + 1 FROM img)) b(z),
          range(0, 21) e(y), range(0, 9) f(x)) g
    LEFT JOIN (SELECT c, z, y + 2 y, x - 3 x, v FROM img) i USING (c, z, y, x)"""))
def pad_crop(spark, d):
    return I.pad_to(S.voxels(spark, d), S.image_info(spark, d), CHANNELS, height=21, width=9)


@query(with_ctes("img", """
    SELECT c, z, CAST(py AS INT) py, CAST(px AS INT) px, CAST(i.y - oy AS INT) y, CAST(i.x - ox AS INT) x, v
    FROM img i JOIN (VALUES (0, 0), (1, 6), (2, 10)) a(py, oy) ON i.y >= oy AND i.y < oy + 6
    JOIN (VALUES (0, 0), (1, 5), (2, 10), (3, 11)) b(px, ox) ON i.x >= ox AND i.x < ox + 5"""))
def patches(spark, d):
    return I.patches(S.voxels(spark, d), S.PLANE, S.PLANE, 6, 5)


@query(with_ctes("img", """
    SELECT c, z, code, CAST(CASE code WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN y WHEN 3 THEN 15 - x
             WHEN 4 THEN y WHEN 5 THEN 15 - x WHEN 6 THEN 15 - y ELSE x END AS INT) y,
           CAST(CASE code WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 15 - x WHEN 3 THEN 15 - y
             WHEN 4 THEN 15 - x WHEN 5 THEN 15 - y WHEN 6 THEN x ELSE y END AS INT) x, v
    FROM img, (SELECT CAST(code AS INT) code FROM range(0, 8) r(code))"""))
def augment8(spark, d):
    return I.augment(S.voxels(spark, d), S.PLANE)


@query()
def noise_gaussian(spark, d):
    return I.gaussian_noise(S.voxels(spark, d), 0.0, 25.0, seed=7)


@query()
def noise_salt_pepper(spark, d):
    return I.salt_and_pepper(S.voxels(spark, d).withColumn("v", F.col("v") / 65535.0),
                             S.image_info(spark, d), 0.1, seed=7)


@query()
def noise_speckle(spark, d):
    return I.speckle_noise(S.voxels(spark, d), 0.1, seed=7)


# ------------------------------------------------------------------- thresholds
@query(with_ctes("img", f"SELECT c, {q6('quantile_cont(v, 0.95)')} thr FROM img GROUP BY c"))
def percentile_threshold(spark, d):
    return TH.percentile_threshold(S.voxels(spark, d)).withColumn("thr", r6("thr"))


@query(with_ctes("img thr mask", "SELECT c, z, y, x, v FROM mask"))
def threshold_mask(spark, d):
    return _mask(spark, d)


@query(with_ctes("img", f"""
    SELECT c, {q6('abs(m1 - m0) / sqrt(0.5 * (s0 * s0 + s1 * s1))')} dprime FROM (
      SELECT c, avg(v) FILTER (WHERE v > thr) m1, stddev_pop(v) FILTER (WHERE v > thr) s1,
             avg(v) FILTER (WHERE v <= thr) m0, stddev_pop(v) FILTER (WHERE v <= thr) s0
      FROM img JOIN thr USING (c) GROUP BY c)""",
    {"thr": "SELECT c, quantile_cont(v, 0.95) thr FROM img GROUP BY c"}))
def dprime(spark, d):
    v = S.voxels(spark, d)
    t = attach(v, TH.percentile_threshold(v), ["c"])
    on, off = F.when(F.col("v") > F.col("thr"), F.col("v")), F.when(F.col("v") <= F.col("thr"), F.col("v"))
    return t.groupBy("c").agg(F.avg(on).alias("m1"), F.stddev_pop(on).alias("s1"), F.avg(off).alias("m0"),
                              F.stddev_pop(off).alias("s0")).select(
        "c", r6(TH.dprime(F.col("m0"), F.col("s0"), F.col("m1"), F.col("s1"))).alias("dprime"))


@query()
def gmm_threshold(spark, d):
    return TH.adaptive_threshold(S.voxels(spark, d))


# ----------------------------------------------------------------------- frames
_NORM = {
    "m": "SELECT c, z, avg(v) m FROM img GROUP BY c, z",
    "lim": "SELECT c, quantile_cont(m, 0.02) lo, quantile_cont(m, 0.98) hi FROM m GROUP BY c",
    "norm": """SELECT c, z, CASE WHEN hi > lo THEN greatest(0, least(1, (m - lo) / (hi - lo))) ELSE 0 END m
               FROM m JOIN lim USING (c)""",
    "ord": """SELECT c, z, m, row_number() OVER (PARTITION BY c ORDER BY m DESC, z) rk,
                     CAST(count(*) OVER (PARTITION BY c) AS INT) total FROM norm""",
}


def _means(spark, d):
    return FR.percentile_normalize(FR.slice_means(S.voxels(spark, d)))


@query(with_ctes("img", f"SELECT c, z, {q6('avg(v)')} m FROM img GROUP BY c, z"))
def slice_mean(spark, d):
    return FR.slice_means(S.voxels(spark, d)).withColumn("m", r6("m"))


@query(with_ctes("img", f"SELECT c, z, {q6('m')} m FROM norm", _NORM))
def percentile_normalize(spark, d):
    return _means(spark, d).withColumn("m", r6("m"))


@query(with_ctes("img", "SELECT c, CAST(rk AS INT) rank, z FROM ord WHERE rk <= 2", _NORM))
def top2_slices(spark, d):
    return FR.top_slices(_means(spark, d), 2)


@query(with_ctes("img", """
    SELECT c, CAST(coalesce(min(z) FILTER (WHERE m > 0.05), 0) AS INT) z_start,
           CAST(coalesce(max(z) FILTER (WHERE m > 0.05) + 1, count(*)) AS INT) z_end FROM norm GROUP BY c""", _NORM))
def z_range(spark, d):
    return FR.usable_range(_means(spark, d))


_RUN = """SELECT c, {tag} tag, unnest(range(greatest(0, least(total, greatest(0, {at} - {n} // 2) + {n}) - {n}),
                 least(total, greatest(0, {at} - {n} // 2) + {n}))) z FROM {src}"""
_SELECT = {
    **_NORM,
    "one": "SELECT c, z ctr, total FROM ord WHERE rk = 1",
    "two": "SELECT c, z ctr, total FROM ord WHERE rk = 2",
    "chosen": "SELECT c, z, min(tag * 100 + pos) pri FROM (SELECT *, row_number() OVER (PARTITION BY c, tag ORDER BY z) pos FROM ("
              + _RUN.format(tag=1, at="ctr", n=5, src="one") + " UNION ALL "
              + _RUN.format(tag=2, at="ctr", n=5, src="two") + ")) GROUP BY c, z",
    "filled": """SELECT c, z, row_number() OVER (PARTITION BY c ORDER BY coalesce(pri, 1000 + rk)) k
                 FROM ord LEFT JOIN chosen USING (c, z)""",
    "clean": "SELECT c, string_agg(z + 1, ',' ORDER BY z) s FROM filled WHERE k <= 10 GROUP BY c",
    "noisy": "SELECT c, string_agg(z + 1, ',' ORDER BY z) s FROM (" + _RUN.format(
        tag=0, at="(total // 2)", n=10, src="one") + ") GROUP BY c",
    "ref": "SELECT c, arg_min(z, rk) + 1 r FROM ord JOIN (" + _RUN.format(
        tag=0, at="ctr", n=5, src="two") + ") USING (c, z) GROUP BY c",
    "zr": """SELECT c, coalesce(min(z) FILTER (WHERE m > 0.05), 0) + 1 || ',' ||
             coalesce(max(z) FILTER (WHERE m > 0.05) + 1, count(*)) s FROM norm GROUP BY c""",
}


@query(with_ctes("img", """
    SELECT c, 'clean frame' frame_type, s slice_index FROM clean
    UNION ALL SELECT c, 'noisy frame', s FROM noisy
    UNION ALL SELECT c, 'reference frame', CAST(r AS VARCHAR) FROM ref
    UNION ALL SELECT c, 'Target range', s FROM zr""", _SELECT))
def frame_selection(spark, d):
    return FR.selection_rows(FR.select_frames(_means(spark, d)))


@query(with_ctes("img", """
    SELECT z, y, x, CAST(trunc(v / m::DOUBLE * 255) AS INT) v
    FROM img, (SELECT max(v) m FROM img WHERE c = 3) WHERE c = 3"""))
def load_channel(spark, d):
    return FR.load_channel(S.voxels(spark, d), 3, 5)


# ------------------------------------------------------------------------ masks
_CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)"
_ERODED = f"""SELECT m.c, m.z, m.y, m.x FROM mask m, {_CROSS}
              JOIN mask n ON n.c = m.c AND n.z = m.z AND n.y = m.y + dy AND n.x = m.x + dx
              GROUP BY ALL HAVING count(*) = 5"""
# a denser mask so that erosion leaves something
_DENSE = {"mask": """SELECT c, z, y, x, v FROM img
                     JOIN (SELECT c, quantile_cont(v, 0.3) thr FROM img GROUP BY c) USING (c) WHERE v > thr"""}


def _dense(spark, d):
    v = S.voxels(spark, d)
    return M.above_threshold(v, TH.percentile_threshold(v, 30.0))


@query(with_ctes("img thr mask", f"""
    SELECT a.c c1, b.c c2, size1, size2, coalesce(inter, 0) inter, size1 + size2 - coalesce(inter, 0) uni,
           {q6('coalesce(inter, 0) / (size1 + size2 - coalesce(inter, 0))')} jaccard,
           {q6('2 * coalesce(inter, 0) / (size1 + size2)')} dice
    FROM (SELECT c, count(*) size1 FROM mask GROUP BY c) a
    JOIN (SELECT c, count(*) size2 FROM mask GROUP BY c) b ON a.c < b.c
    LEFT JOIN (SELECT p.c k1, q.c k2, count(*) inter FROM mask p
               JOIN mask q ON p.z = q.z AND p.y = q.y AND p.x = q.x AND p.c < q.c GROUP BY ALL)
           ON k1 = a.c AND k2 = b.c"""))
def channel_overlap(spark, d):
    return M.pair_overlap(_mask(spark, d)).withColumns({"jaccard": r6("jaccard"), "dice": r6("dice")})


@query(with_ctes("img", _ERODED, _DENSE))
def erode(spark, d):
    return M.erode(_dense(spark, d))


@query(with_ctes("img thr mask", f"""
    SELECT DISTINCT c, z, y + dy y, x + dx x FROM mask, {_CROSS}
    WHERE y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15"""))
def dilate(spark, d):
    return M.dilate(_mask(spark, d), S.image_info(spark, d))


@query(with_ctes("img info thr mask", """
    SELECT DISTINCT c, z + dz z, y + dy y, x + dx x
    FROM mask, info, (VALUES (-1), (0), (1)) a(dz), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) e(dx)
    WHERE z + dz >= 0 AND z + dz < depth AND y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15"""))
def dilate3d(spark, d):
    return M.dilate(_mask(spark, d), S.image_info(spark, d), offsets=M.CUBE)


@query(with_ctes("img", f"""
    SELECT c, z, count(*) area, count(*) - count(kept) perimeter,
           {q6('(count(*) - count(kept)) * (count(*) - count(kept)) / count(*)')} compactness
    FROM mask LEFT JOIN (SELECT c, z, y, x, 1 kept FROM eroded) USING (c, z, y, x) GROUP BY c, z""",
    {**_DENSE, "eroded": _ERODED}))
def perimeter(spark, d):
    m = _dense(spark, d)
    edge = M.perimeter(m).groupBy("c", "z").agg(F.count(F.lit(1)).alias("perimeter"))
    area = m.groupBy("c", "z").agg(F.count(F.lit(1)).alias("area"))
    return area.join(edge, ["c", "z"], "left").select(
        "c", "z", "area", F.coalesce("perimeter", F.lit(0).cast("long")).alias("perimeter"),
        r6(F.pow(F.coalesce("perimeter", F.lit(0)), 2) / F.col("area")).alias("compactness"))
