"""Adaptive equalisation and the shading plans that use it, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.resample import resize_stack
from lumenframe.model import FlatfieldSettings
from lumenframe.operators import enhance as E
from lumenframe.operators import shading as SH
from lumenframe.plans import shading as SP


def plain_adaptive(a, clip, kernel, top):
    """The same steps over one image."""
    kh, kw = kernel
    lo, hi = int(a.min()), int(a.max())
    if lo == hi:
        return a
    bins = (np.rint((a - lo) / (hi - lo) * 16383) // 65).astype(int)
    ph, pw = -a.shape[0] % kh, -a.shape[1] % kw
    padded = np.pad(bins, ((0, ph), (0, pw)), "reflect")
    n, m = padded.shape[0] // kh, padded.shape[1] // kw
    limit = max(int(clip * kh * kw), 1) if clip > 0 else kh * kw
    tables = np.zeros((n, m, 256), int)
    for i, j in np.ndindex(n, m):
        hist = np.bincount(padded[i * kh:(i + 1) * kh, j * kw:(j + 1) * kw].ravel(), minlength=256)
        tables[i, j] = np.minimum(np.cumsum(E.limited(hist, limit)) * (16383 / (kh * kw)), 16383).astype(int)
    out = np.zeros(a.shape)
    for y, x in np.ndindex(a.shape):
        (by, fy), (bx, fx) = divmod(y + kh // 2, kh), divmod(x + kw // 2, kw)
        for dy, dx in np.ndindex(2, 2):
            t = tables[min(max(by - 1 + dy, 0), n - 1), min(max(bx - 1 + dx, 0), m - 1)]
            out[y, x] += t[bins[y, x]] * [1 - fy / kh, fy / kh][dy] * [1 - fx / kw, fx / kw][dx]
    out = np.floor(out + 1e-6)
    return np.floor((out - out.min()) / max(out.max() - out.min(), 1) * top + 1e-6).astype(int)


def test_surplus_is_dealt_back():
    rng = np.random.default_rng(3)
    for _ in range(200):
        hist = rng.multinomial(int(rng.integers(1, 4000)), rng.dirichlet(np.full(256, 0.05)))
        limit = int(rng.integers(1, 60))
        got = E.limited(hist, limit)
        assert (got >= np.minimum(hist, limit)).all() and got.max() <= limit
        assert got.sum() >= min(hist.sum(), 256 * limit)      # the last stride may deal a little more than is left
        assert got.sum() - hist.sum() < 256
    assert (E.limited(np.full(256, 3), 5) == 3).all()


@pytest.mark.parametrize("shape,kernel,clip", [((21, 34), None, 0.01), ((20, 17), (6, 5), 0.2), ((9, 9), (4, 4), 0.0), ((8, 8), (1, 1), 0.5)])
def test_adaptive_equalisation(spark, shape, kernel, clip):
    rng = np.random.default_rng(shape[0])
    images = {(1, 0): rng.integers(0, 65536, shape), (1, 1): (rng.normal(300, 40, shape).clip(0)).astype(int), (2, 0): np.full(shape, 77)}
    rows = [(c, z, int(y), int(x), int(a[y, x])) for (c, z), a in images.items() for y, x in np.ndindex(shape)]
    v = spark.createDataFrame(rows, "c int, z int, y int, x int, v int").repartition(4)
    got = {k: np.zeros(shape, int) for k in images}
    for r in E.equalize_adaptive(v, *shape, 65535, clip, kernel).collect():
        got[r["c"], r["z"]][r["y"], r["x"]] = r["v"]
    for k, a in images.items():
        assert (got[k] == plain_adaptive(a, clip, kernel or (max(shape[0] // 8, 1), max(shape[1] // 8, 1)), 65535)).all()


def scene(n_z=14, side=16, stride=12, channels=(1, 2)):
    """Tile rows of a flat scene with spots under a planted field, the field, and the scene's brightness by slice."""
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[:side, :side] / side - 0.5
    flat = 1.15 - 0.9 * (yy ** 2 + xx ** 2)
    flat /= flat.mean()
    level = rng.uniform(4000, 9000, n_z)
    rows = []
    for c in channels:
        for z in range(n_z):
            for ty, tx in np.ndindex(2, 2):
                spots = (rng.random((side, side)) < 0.02) * 8000
                rows.append((c, z, ty, tx, [int(v) for v in ((level[z] + spots) * flat + rng.normal(0, 30, (side, side))).ravel()]))
    return rows, flat, level


def test_entry_flow_flattens_the_image(spark):
    """The field comes from decimated tiles, is widened and applied to full ones."""
    rows, flat, level = scene()
    tiles = spark.createDataFrame(rows, "c int, z int, ty int, tx int, px array<int>").repartition(3)
    out = SP.entry_correction(tiles, (16, 16), 12, 65535, channels=[1], ratio=4)
    stats = out.groupBy("c", "z").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("m"),
                                      F.percentile("v", F.lit(0.1)).alias("low"), F.percentile("v", F.lit(0.9)).alias("high")).collect()
    assert len(stats) == 2 * len(level)
    for r in stats:
        assert r["n"] == 28 * 28
        spread = (r["high"] - r["low"]) / r["m"]
        assert spread < 0.08 if r["c"] == 1 else spread > 0.1       # channel 2 is left alone
        if r["c"] == 1:
            assert r["m"] == pytest.approx(level[r["z"]], rel=0.05)


def test_decimation_and_widening(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1000, (3, 10, 7))
    tiles = spark.createDataFrame([(i, [int(v) for v in t.ravel()]) for i, t in enumerate(a)], "i int, px array<int>")
    got = {r["i"]: np.array(r["px"]) for r in SH.decimate_tiles(tiles, (10, 7), 4).collect()}
    for i, t in enumerate(a):
        want = [[t[y:y + 4, x:x + 4].mean() for x in (0, 4)] for y in (0, 4, 8)]
        assert np.allclose(got[i], np.ravel(want))
    field = spark.createDataFrame([(1, y, x, float(y * 3 + x + 1)) for y in range(3) for x in range(4)], "c int, y int, x int, flat double")
    wide = np.zeros((12, 16))
    for r in SH.resize_field(field, (3, 4), (12, 16)).collect():
        wide[r["y"], r["x"]] = r["flat"]
    small = np.array([[y * 3 + x + 1.0 for x in range(4)] for y in range(3)])
    assert np.allclose(wide, resize_stack(small, 12, 16, "cubic", False, -0.75))


def test_normalisation_comes_before_the_inversion_is_turned_back(spark):
    rows, flat, _ = scene(2, 8, 6)
    tiles = spark.createDataFrame(rows, "c int, z int, ty int, tx int, px array<int>")
    field = spark.createDataFrame([(c, int(y), int(x), 1.0) for c in (1, 2) for y, x in np.ndindex(8, 8)], "c int, y int, x int, flat double")
    plain = SP.full_correction(tiles, field, 8, 6, 65535, invert=[2])
    done = SP.full_correction(tiles, field, 8, 6, 65535, invert=[2], normalize=[2], clip_limit=0.1, kernel=(5, 5), shape=(14, 14))
    image = lambda df, c, z: {(r["y"], r["x"]): r["v"] for r in df.filter((F.col("c") == c) & (F.col("z") == z)).collect()}
    grid = lambda d: np.array([[d[y, x] for x in range(14)] for y in range(14)])
    for z in (0, 1):
        assert image(plain, 1, z) == image(done, 1, z)
        before = grid(image(plain, 2, z))
        want = plain_adaptive(np.where(before == 0, 0, 65535 - before), 0.1, (5, 5), 65535)
        assert (grid(image(done, 2, z)) == np.where(want == 0, 0, 65535 - want)).all()
    with pytest.raises(ValueError):
        SP.full_correction(tiles, field, 8, 6, 65535, normalize=[1])


def test_interpolated_background_in_the_plan(spark):
    """A background that grows along the grid of tiles is taken out, also under the mask."""
    rows = [(1, 0, ty, tx, [int(100 + 10 * ty + 5 * tx)] * 64) for ty in range(4) for tx in range(4)]
    tiles = spark.createDataFrame(rows, "c int, z int, ty int, tx int, px array<int>")
    field = spark.createDataFrame([(1, int(y), int(x), 1.0) for y, x in np.ndindex(8, 8)], "c int, y int, x int, flat double")
    mask = spark.createDataFrame([(y, x) for y in range(8, 16) for x in range(8, 16)], "y int, x int")
    out = SP.full_correction(tiles, field, 8, 8, 65535, background=[1], method="annotation_interpolate", mask=mask, overlap=0.0).collect()
    inside = [r["v"] for r in out if 8 <= r["y"] < 16 and 8 <= r["x"] < 16]
    assert len(out) == 32 * 32 and max(r["v"] for r in out if not (8 <= r["y"] < 16 and 8 <= r["x"] < 16)) <= 1 and max(inside) <= 3
