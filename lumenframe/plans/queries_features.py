"""Registered queries: features, enhancement, agreement measures and denoising."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import denoise as D
from lumenframe.operators import enhance as E
from lumenframe.operators import features as X
from lumenframe.operators import image as I
from lumenframe.operators import metrics as Q
from lumenframe.operators import overlap as O
from lumenframe.operators import roi as R
from lumenframe.operators import skeleton as SK
from lumenframe.plans.catalog import BAG_BASE, q6, query, r6, reach, with_ctes
from lumenframe.plans.queries_puncta import (
    _CLIQUE, _PAIRS, _RM, _mask, _neurites, _roi_mask, _rois)
from lumenframe.sources import tables as S

_BASE = BAG_BASE + " cmask"


def _grouped(spark, d):
    return O.by_punctum(O.plane_words(_roi_mask(spark, d)))


# --------------------------------------------------------------------- features
_PIX = {"pix": """SELECT punctum_id, c, count(*) pix, count(DISTINCT z) zcount,
                         count(*) / greatest(sum(count(*)) OVER (PARTITION BY punctum_id), 1) rel_pix
                  FROM rm GROUP BY punctum_id, c"""}


@query(with_ctes(_BASE, f"""
    SELECT punctum_id, c, CAST(pix AS INT) pix, CAST(zcount AS INT) zcount,
           ((y2 - y1) * (x2 - x1))::DOUBLE bbox_area, {q6('rel_pix')} rel_pix
    FROM pix JOIN roi USING (punctum_id)""", {**_RM, **_PIX}))
def channel_features(spark, d):
    return R.to_puncta(X.pixel_features(_grouped(spark, d)).withColumn("rel_pix", r6("rel_pix")), _rois(spark, d))


def _ratio_sql():
    cols = []
    for a, b in ((1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)):
        cols.append(f"{q6(f'CASE WHEN p{b} > 0 THEN p{a} / p{b} ELSE 0 END')} ch{a}_pix_over_ch{b}_pix")
        cols.append(f"{q6(f'r{a} - r{b}')} ch{a}_rel_minus_ch{b}_rel")
    wide = ", ".join(f"coalesce(max(pix) FILTER (WHERE c = {c}), 0) p{c}, "
                     f"coalesce(max(rel_pix) FILTER (WHERE c = {c}), 0) r{c}" for c in (1, 2, 3, 5))
    return f"SELECT punctum_id, {', '.join(cols)} FROM (SELECT punctum_id, {wide} FROM pix GROUP BY 1)"


@query(with_ctes(_BASE, _ratio_sql(), {**_RM, **_PIX}))
def pixel_ratios(spark, d):
    out = X.ratio_features(X.pixel_features(_grouped(spark, d)))
    return R.to_puncta(out.withColumns({c: r6(c) for c in out.columns if c != "punctum_id"}), _rois(spark, d))


@query(with_ctes(_BASE, f"""
    SELECT punctum_id, c, CAST(count(*) AS INT) area, CAST(count(*) - count(e) AS INT) perimeter,
           {q6('(count(*) - count(e)) * (count(*) - count(e)) / count(*)')} compactness
    FROM flat LEFT JOIN (SELECT f.punctum_id, f.c, f.y, f.x, 1 e FROM flat f,
        (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx)
        JOIN flat g ON g.punctum_id = f.punctum_id AND g.c = f.c AND g.y = f.y + dy AND g.x = f.x + dx
        GROUP BY ALL HAVING count(*) = 5) USING (punctum_id, c, y, x)
    GROUP BY punctum_id, c""", {**_RM, "flat": "SELECT DISTINCT punctum_id, c, y, x FROM rm"}))
def shape_features(spark, d):
    return R.to_puncta(X.shape_features(_grouped(spark, d)).withColumn("compactness", r6("compactness")), _rois(spark, d))


_GRAPH = {
    "edge": "SELECT *, jm AS pp FROM prob WHERE shared AND jm >= 0.3",
    **{k: v.replace("avg(p) ap", "avg(jm) ap") for k, v in _CLIQUE.items() if k in ("sets", "clq")},
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY punctum_id ORDER BY k DESC, label) rn FROM clq)
              WHERE rn = 1""",
    "maxi": """SELECT punctum_id, count(*) n FROM clq a WHERE NOT EXISTS (
                 SELECT 1 FROM clq b WHERE b.punctum_id = a.punctum_id AND b.k > a.k AND list_has_all(b.chans, a.chans))
               GROUP BY 1""",
    "nodes": "SELECT punctum_id, count(*) n FROM det GROUP BY 1",
}


@query(with_ctes(_BASE, f"""
    SELECT punctum_id, {q6('coalesce(a.jm, 0)')} pairs_jacc_mean, {q6('coalesce(a.dm, 0)')} pairs_dice_mean,
           {q6('coalesce(a.jx, 0)')} pairs_jacc_max, {q6('coalesce(a.jn, 0)')} pairs_jacc_min,
           CAST(coalesce(e.n, 0) AS INT) graph_edge_count, CAST(CASE WHEN o.n > 1 THEN o.n ELSE 0 END AS INT) graph_node_count,
           {q6('CASE WHEN o.n > 1 THEN 2.0::DOUBLE * coalesce(e.n, 0) / (o.n * (o.n - 1)) ELSE 0 END')} graph_density,
           CAST(coalesce(m.n, 0) AS INT) graph_clique_count, CAST(coalesce(t.k, 0) AS INT) graph_max_clique_size,
           {q6('coalesce(t.ap, 0)')} best_clique_score,
           {q6('coalesce(b.pm, 0)')} rule_mean_overlap, {q6('coalesce(b.px, 0)')} rule_max_overlap
    FROM nodes o LEFT JOIN (SELECT punctum_id, avg(jm) jm, avg(dm) dm, max(jm) jx, min(jm) jn FROM prob WHERE shared GROUP BY 1) a USING (punctum_id)
    LEFT JOIN (SELECT punctum_id, avg(p) pm, max(p) px FROM prob GROUP BY 1) b USING (punctum_id)
    LEFT JOIN (SELECT punctum_id, count(*) n FROM edge GROUP BY 1) e USING (punctum_id)
    LEFT JOIN maxi m USING (punctum_id) LEFT JOIN top t USING (punctum_id)""", {**_RM, **_PAIRS, **_GRAPH}))
def graph_features(spark, d):
    g = X.graph_features(X.pair_table(O.multiscale(O.pair_masks(_grouped(spark, d)))), 0.3)
    g = g.drop("chans", "pairs", "rule_clique_score", "rule_clique_size")
    return R.to_puncta(g.withColumns({c: r6(c) for c, t in g.dtypes if t == "double"}), _rois(spark, d))


@query(with_ctes(_BASE, f"""
    SELECT punctum_id, CAST(coalesce(t.k, 0) AS INT) rule_clique_size, {q6('coalesce(t.ap, 0)')} rule_clique_score
    FROM nodes LEFT JOIN top t USING (punctum_id)""",
    {**_RM, **_PAIRS, **_GRAPH, "edge": "SELECT * FROM prob WHERE p >= 0.3", "clq": _CLIQUE["clq"]}))
def rule_features(spark, d):
    g = X.graph_features(X.pair_table(O.multiscale(O.pair_masks(_grouped(spark, d)))), 0.3)
    return R.to_puncta(g.select("punctum_id", "rule_clique_size", r6("rule_clique_score").alias("rule_clique_score")), _rois(spark, d))


@query(with_ctes(_BASE, f"""
    SELECT punctum_id, c, {q6('CASE WHEN n > 1 THEN -ln(sqrt(vy) * sqrt(vx) + 1e-8) ELSE 0 END')} spatial_entropy
    FROM (SELECT punctum_id, c, n, vy, vx, row_number() OVER (PARTITION BY punctum_id, c ORDER BY n DESC, label) rn
          FROM (SELECT punctum_id, c, label, count(*) n, var_pop(y) vy, var_pop(x) vx FROM lab GROUP BY 1, 2, 3))
    WHERE rn = 1""", {**_RM, "flat": "SELECT DISTINCT punctum_id, c, y, x FROM rm",
                      **reach("flat", "punctum_id, c", eight=False)}, recursive=True))
def roi_entropy(spark, d):
    key = ["punctum_id", "c"]
    flat = X.local_pixels(_roi_mask(spark, d)).drop("z").distinct()
    big = X.C.largest(X.C.regions(X.label_rois(flat, key), key), key)
    return R.to_puncta(X.C.with_entropy(big).select(*key, r6("entropy").alias("spatial_entropy")), _rois(spark, d))


@query()
def feature_vectors(spark, d):
    """All 99 model inputs; skeleton lengths come from an iterative kernel, so no SQL."""
    puncta, info = S.puncta(spark, d), S.image_info(spark, d)
    near = R.local_neurites(puncta, _neurites(spark, d), info)
    return X.feature_vector(X.feature_table(puncta, _roi_mask(spark, d), near, rois=_rois(spark, d)))


@query()
def skeleton(spark, d):
    return SK.skeletonize(_mask(spark, d), ["c", "z"])


# ------------------------------------------------------------------ enhancement
# 8-bit view of the image
_U8 = {"u8": "SELECT c, z, y, x, CAST(trunc(v / 257) AS INT) v FROM img"}


def _u8(spark, d):
    return S.voxels(spark, d).withColumn("v", F.floor(F.col("v") / 257).cast("int"))


@query(with_ctes("img", f"""
    SELECT u8.c, u8.z, y, x, u8.v, {q6('''CASE WHEN lo.q IS NULL THEN hi.v WHEN hi.q = lo.q THEN lo.v
             ELSE lo.v + (hi.v - lo.v) * (s.q - lo.q) / (hi.q - lo.q) END''')} matched
    FROM s ASOF LEFT JOIN t lo ON s.c = lo.c AND s.q >= lo.q
    ASOF LEFT JOIN t hi ON s.c = hi.c AND s.q <= hi.q
    JOIN u8 ON u8.c = s.c AND u8.z = s.z AND u8.v = s.v""",
    {**_U8,
     "s": """SELECT c, z, v, sum(n) OVER (PARTITION BY c, z ORDER BY v) / sum(n) OVER (PARTITION BY c, z) q
             FROM (SELECT c, z, v, count(*) n FROM u8 GROUP BY ALL)""",
     "t": """SELECT c, v::DOUBLE v, sum(n) OVER (PARTITION BY c ORDER BY v) / sum(n) OVER (PARTITION BY c) q
             FROM (SELECT c, v, count(*) n FROM u8 WHERE z = 3 GROUP BY ALL)"""}))
def hist_match(spark, d):
    v = _u8(spark, d)
    return E.match_histograms(v, v.filter("z = 3")).withColumn("matched", r6("matched"))


# 5x5 tiles of 4 pixels over 16: the plane is mirrored to 20
_CLAHE = {
    **_U8,
    "px": """SELECT c, z, yy // 4 ty, xx // 4 tx, v FROM u8,
             LATERAL (SELECT unnest([y, CASE WHEN y < 15 AND 30 - y < 20 THEN 30 - y END]) yy) a,
             LATERAL (SELECT unnest([x, CASE WHEN x < 15 AND 30 - x < 20 THEN 30 - x END]) xx) b
             WHERE yy IS NOT NULL AND xx IS NOT NULL""",
    "h": "SELECT c, z, ty, tx, v, count(*) n FROM px GROUP BY ALL",
    "o": "SELECT c, z, ty, tx, sum(greatest(n - 2, 0))::INT ov FROM h GROUP BY ALL",
    "fill": """SELECT o.c, o.z, o.ty, o.tx, i::INT i, least(coalesce(n, 0), 2) + ov // 256
              + CASE WHEN ov % 256 > 0 AND i % greatest(256 // greatest(ov % 256, 1), 1) = 0
                      AND i // greatest(256 // greatest(ov % 256, 1), 1) < ov % 256 THEN 1 ELSE 0 END n
            FROM o CROSS JOIN range(0, 256) r(i)
            LEFT JOIN h ON h.c = o.c AND h.z = o.z AND h.ty = o.ty AND h.tx = o.tx AND h.v = i""",
    "lut": """SELECT c, z, ty, tx, i, least(255, round_even(sum(n) OVER (PARTITION BY c, z, ty, tx ORDER BY i)
                     * (255.0::DOUBLE / 16), 0)) l FROM fill""",
    "p": """SELECT c, z, y, x, v, floor(y / 4.0::DOUBLE - 0.5)::INT cy, floor(x / 4.0::DOUBLE - 0.5)::INT cx,
                   y / 4.0::DOUBLE - 0.5 - floor(y / 4.0::DOUBLE - 0.5) ya, x / 4.0::DOUBLE - 0.5 - floor(x / 4.0::DOUBLE - 0.5) xa
            FROM u8""",
}


@query(with_ctes("img", """
    SELECT p.c, p.z, y, x, round_even((a.l * (1 - xa) + b.l * xa) * (1 - ya) + (e.l * (1 - xa) + f.l * xa) * ya, 0)::INT v
    FROM p
    JOIN lut a ON a.c = p.c AND a.z = p.z AND a.i = p.v AND a.ty = greatest(cy, 0) AND a.tx = greatest(cx, 0)
    JOIN lut b ON b.c = p.c AND b.z = p.z AND b.i = p.v AND b.ty = greatest(cy, 0) AND b.tx = least(cx + 1, 4)
    JOIN lut e ON e.c = p.c AND e.z = p.z AND e.i = p.v AND e.ty = least(cy + 1, 4) AND e.tx = greatest(cx, 0)
    JOIN lut f ON f.c = p.c AND f.z = p.z AND f.i = p.v AND f.ty = least(cy + 1, 4) AND f.tx = least(cx + 1, 4)""", _CLAHE))
def clahe(spark, d):
    return E.equalize_tiles(_u8(spark, d), S.PLANE, S.PLANE, clip=40.0, grid=(5, 5))


# ----------------------------------------------------- agreement and denoising
# neighbouring channels of the 8-bit image stand in for prediction and truth
_AB = {**_U8, "ab": """SELECT a.c, a.z, a.y, a.x, a.v a, b.v b FROM u8 a JOIN u8 b
                       ON b.c = a.c + 1 AND b.z = a.z AND b.y = a.y AND b.x = a.x"""}


def _ab(spark, d):
    v = _u8(spark, d)
    nxt = v.select((F.col("c") - 1).alias("c"), "z", "y", "x", F.col("v").alias("b"))
    return v.withColumnRenamed("v", "a").join(nxt, ["c", "z", "y", "x"])


@query(with_ctes("img", f"SELECT c, {q6('10 * log10(65025.0::DOUBLE / avg((a - b) * (a - b)))')} psnr FROM ab GROUP BY c", _AB))
def psnr(spark, d):
    return Q.psnr(_ab(spark, d)).withColumn("psnr", r6("psnr"))


@query(with_ctes("img", f"""
    SELECT c, {q6('count(*) FILTER (WHERE a > 140 AND b > 140) / count(*) FILTER (WHERE a > 140 OR b > 140)')} iou
    FROM ab GROUP BY c""", _AB))
def mask_iou(spark, d):
    t = _ab(spark, d).withColumns({"a": (F.col("a") > 140).cast("int"), "b": (F.col("b") > 140).cast("int")})
    return Q.iou(t).withColumn("iou", r6("iou"))


@query(with_ctes("img", f"""
    SELECT c, z, {q6('avg((2 * ma * mb + 6.5025) / (ma * ma + mb * mb + 6.5025) * (2 * (mab - ma * mb) + 58.5225) / (maa + mbb - ma * ma - mb * mb + 58.5225))')} ssim
    FROM (SELECT c, z, wy, wx, sum(g * a) ma, sum(g * b) mb, sum(g * a * b) mab, sum(g * a * a) maa, sum(g * b * b) mbb
          FROM (SELECT ab.c, ab.z, wy, wx, a, b, gy.g * gx.g g FROM ab
                JOIN k gy ON true JOIN k gx ON true,
                LATERAL (SELECT y - gy.r wy, x - gx.r wx)
                WHERE wy BETWEEN 5 AND 10 AND wx BETWEEN 5 AND 10) GROUP BY ALL)
    GROUP BY c, z""", {**_AB, "k0": "SELECT r, exp(-(r * r) / 4.5) e FROM range(-5, 6) q(r)",
                       "k": "SELECT r, e / (SELECT sum(e) FROM k0) g FROM k0"}))
def ssim(spark, d):
    return Q.ssim(_ab(spark, d), block=8, shape=(S.PLANE, S.PLANE)).withColumn("ssim", r6("ssim"))


@query(with_ctes("img", f"""
    SELECT c, z, y, x, {q6('(0.5 * greatest(-1, least(1, n * 1.5)) + 0.5 * greatest(-1, least(1, n - (n * 0.2 - 0.1))) + 1) * 0.5 * 255')} v,
           CAST(trunc(least(65535, greatest(0, (0.5 * greatest(-1, least(1, n * 1.5))
             + 0.5 * greatest(-1, least(1, n - (n * 0.2 - 0.1))) + 1) * 0.5 * 255 * (65535.0::DOUBLE / 255)))) AS INT) wide
    FROM (SELECT c, z, y, x, v / 255.0::DOUBLE * 2 - 1 n FROM u8)""".replace("0.5 *", "0.5::DOUBLE *").replace(
        "n * 1.5", "n * 1.5::DOUBLE").replace("n * 0.2 - 0.1", "n * 0.2::DOUBLE - 0.1::DOUBLE"), _U8))
def denoise_blend(spark, d):
    n = I.to_signed_unit(F.col("v"))
    mixed = D.blend(n, n * 1.5, n * 0.2 - 0.1)
    return _u8(spark, d).select("c", "z", "y", "x", r6(mixed).alias("v"), D.to_output(mixed, "uint16").alias("wide"))


@query(with_ctes("img", f"""
    SELECT c, z, CAST(ly AS INT) ly, CAST(lx AS INT) lx, ty, tx,
           {q6('(0.5::DOUBLE * greatest(-1, least(1, n * 0.9::DOUBLE)) + 0.5::DOUBLE * greatest(-1, least(1, n - n * 0.1::DOUBLE)) + 1) * 0.5 * 255')} v
    FROM (SELECT *, v / 65535.0::DOUBLE * 2 - 1 n FROM img)"""))
def denoise_tiles(spark, d):
    t = S.tiles(spark, d).withColumn("px", F.transform("px", lambda p: p / 65535.0 * 2 - 1))
    out = D.denoise_tiles(t, lambda x: x * 0.9, lambda x: x * 0.1, (S.TILE, S.TILE))
    return out.select("c", "z", "ty", "tx", F.posexplode("denoised").alias("i", "v")).select(
        "c", "z", F.floor(F.col("i") / S.TILE).cast("int").alias("ly"), (F.col("i") % S.TILE).alias("lx"),
        "ty", "tx", r6("v").alias("v"))
