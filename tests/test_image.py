"""Image, frame, threshold, shading and file operators on small fixtures."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import lowrank as L
from lumenframe.functions.mixture import fit_two_gaussians
from lumenframe.functions.resample import cosine_matrix, resize_matrix
from lumenframe.model import FlatfieldSettings, ThresholdSettings
from lumenframe.operators import chromatic as CH
from lumenframe.operators import frames as FR
from lumenframe.operators import image as I
from lumenframe.operators import relational as RL
from lumenframe.operators import shading as SH
from lumenframe.operators import thresholds as TH
from lumenframe.sources import puncta_files as PF
from lumenframe.sources import tiff as TF

VOX = "c int, z int, y int, x int, v int"


def voxels(spark, array, c=1):
    return spark.createDataFrame([(c, int(z), int(y), int(x), int(array[z, y, x])) for z, y, x in np.ndindex(array.shape)], VOX)


def info(spark, d, h, w):
    return spark.createDataFrame([(d, h, w)], "depth int, height int, width int")


def test_stitch_saturation_and_gap(spark):
    rows = [(1, 0, 0, 0, 10), (1, 0, 0, 1, 255), (1, 0, 0, 1, 255), (1, 0, 0, 2, 20), (1, 0, 0, 2, 30)]
    df = spark.createDataFrame(rows, VOX).withColumn("v", I.saturate(F.col("v") / 2.0, F.col("v"), 255))
    got = {r["x"]: (r["v"], r["coverage"]) for r in I.fill_uncovered(I.stitch(df), [1], info(spark, 1, 1, 4)).collect()}
    assert got == {0: (5.0, 1), 1: (255.0, 2), 2: (12.5, 2), 3: (0.0, 0)}


def test_pad_to_multiple_pads_exact_sizes(spark):
    for n, want in ((7, 8), (8, 12)):
        a = np.ones((1, n, n))
        out = I.pad_to_multiple(voxels(spark, a), info(spark, 1, n, n), [1])
        assert out.count() == want * want and out.agg(F.sum("v")).first()[0] == n * n


def test_pad_and_crop_odd_pixel(spark):
    a = np.arange(1, 6).reshape(1, 1, 5)
    out = I.pad_to(voxels(spark, a), info(spark, 1, 1, 5), [1], width=8)
    assert [r["v"] for r in out.orderBy("x").collect()] == [0, 1, 2, 3, 4, 5, 0, 0]
    out = I.pad_to(voxels(spark, a), info(spark, 1, 1, 5), [1], width=2)
    assert [r["v"] for r in out.orderBy("x").collect()] == [2, 3]


def test_augment_matches_numpy(spark):
    a = np.arange(9).reshape(1, 3, 3)
    got = {}
    for r in I.augment(voxels(spark, a), 3).collect():
        got.setdefault(r["code"], np.zeros((3, 3), int))[r["y"], r["x"]] = r["v"]
    for flip in (0, 1):
        for turn in range(4):
            want = a[0] if flip == turn == 0 else np.flip(np.rot90(a[0], turn), flip)
            assert (got[flip * 4 + turn] == want).all()


def test_patches_align_last(spark):
    a = np.arange(100).reshape(1, 10, 10)
    p = I.patches(voxels(spark, a), 10, 10, 4, 4)
    last = p.filter("py = 2 and px = 2").orderBy("y", "x").collect()
    assert [r["v"] for r in last] == list(a[0, -4:, -4:].ravel()) and p.count() == 9 * 16


def test_noise_is_repeatable(spark):
    v = voxels(spark, np.full((2, 40, 40), 100))
    a = I.gaussian_noise(v, 5.0, 10.0, seed=1)
    assert a.exceptAll(I.gaussian_noise(v.repartition(3), 5.0, 10.0, seed=1)).count() == 0
    m, s = a.agg(F.avg("v"), F.stddev_pop("v")).first()
    assert abs(m - 105) < 1 and abs(s - 10) < 1
    sp = I.salt_and_pepper(v, info(spark, 2, 40, 40), 0.2).groupBy("v").count().collect()
    share = {r["v"]: r["count"] / 3200 for r in sp}
    assert 0.07 < share[0.0] < 0.13 and 0.06 < share[1.0] < 0.12
    with pytest.raises(ValueError):
        I.speckle_noise(v, 2.0)


def frames(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "c int, z int, m double")


def test_frame_selection_edges(spark):
    flat = FR.percentile_normalize(frames(spark, [5, 5, 5]))
    assert {r["m"] for r in flat.collect()} == {0.0}
    r = FR.select_frames(flat).first()
    assert list(r["clean"]) == [0, 1, 2] and r["reference"] == 0 and (r["z_start"], r["z_end"]) == (0, 3)
    one = FR.select_frames(frames(spark, [0.7])).first()
    assert list(one["clean"]) == [0] and list(one["noisy"]) == [0] and one["reference"] == 0
    assert FR.select_frames(frames(spark, [0.0]).filter("z > 5")).count() == 0
    peak = [0.0, 0.1, 0.9, 0.1] + [0.2] * 20 + [1.0, 0.3, 0.0]
    r = FR.select_frames(frames(spark, peak)).first()
    assert list(r["clean"]) == [0, 1, 2, 3, 4, 22, 23, 24, 25, 26] and r["reference"] == 2
    assert list(r["noisy"]) == list(range(8, 18)) and (r["z_start"], r["z_end"]) == (1, 26)
    text = {x["frame_type"]: x["slice_index"] for x in FR.selection_rows(FR.select_frames(frames(spark, peak))).collect()}
    assert text["reference frame"] == "3" and text["Target range"] == "2,26"
    with pytest.raises(ValueError):
        FR.load_channel(frames(spark, [1]), 4, 3)


def test_mixture_and_fallback(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(50, 5, 4000), rng.normal(150, 10, 1000)]).round().astype(int)
    df = spark.createDataFrame([(1, int(x)) for x in v] + [(2, int(x)) for x in range(9)] + [(3, 7)] * 50, "c int, v int")
    got = {r["c"]: r for r in TH.adaptive_threshold(df).collect()}
    assert abs(got[1]["thr"] - 100) < 2 and got[1]["dprime"] > 5
    assert got[2]["thr"] == pytest.approx(np.percentile(range(9), 95)) and got[2]["dprime"] is None
    assert got[3]["thr"] == 7.0
    strict = TH.adaptive_threshold(df, ThresholdSettings(dprime_thresh=1e9))
    assert {r["c"]: r["thr"] for r in strict.collect()}[1] == pytest.approx(np.percentile(v, 95))
    assert fit_two_gaussians(np.array([1.0, 2.0]), np.array([3.0, 4.0]), 10) is None


def test_lookup_join_without_broadcast(spark, monkeypatch):
    """The salted path gives the same rows as the broadcast one, with one group holding most."""
    v = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).cast("int").alias("z"),
                                 F.col("id").alias("v"))
    look = spark.createDataFrame([(z, z * 10) for z in range(6)], "z int, w int")
    small = RL.attach(v, look, ["z"], "left")
    monkeypatch.setattr(RL, "BROADCAST_BYTES", 0)
    large = RL.attach(v, look, ["z"], "left")
    assert small.count() == 5000 and small.exceptAll(large.select(*small.columns)).count() == 0


def stack(n=40, side=12, seed=0):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:side, :side] / side - 0.5
    flat = 1.2 - 1.2 * (yy ** 2 + xx ** 2)
    flat /= flat.mean()
    level = rng.uniform(80, 200, n)
    spots = (rng.random((n, side, side)) < 0.05) * rng.uniform(0, 300, (n, side, side))
    return level[:, None, None] * flat + spots + rng.normal(0, 1, (n, side, side)), flat, level


def test_flatfield_recovers_known_field(spark):
    d, flat, _ = stack()
    tiles = spark.createDataFrame([(1, [float(v) for v in t.ravel()]) for t in d], "c int, px array<double>")
    out = SH.estimate_flatfield(tiles, (12, 12), FlatfieldSettings(working_size=12)).toPandas().sort_values(["y", "x"])
    assert np.abs(out.flat.to_numpy() - flat.ravel()).max() < 0.08 and abs(out.flat.mean() - 1) < 1e-9


def plain_fit(d, side, s):
    """The same rounds over one matrix."""
    flat, dark, centre = np.ones(side * side), np.zeros(side * side), 0.0
    for _ in range(s.rounds):
        flat, dark, centre, moved = L.update(L.pixel_sums(d, flat, dark, centre, s), flat, dark, d.min(), side, s)
        if moved <= s.tolerance:
            break
    return flat, dark


@pytest.mark.parametrize("dark", [False, True])
def test_all_stacks_in_one_plan(spark, dark):
    """Twelve stacks of unequal size, two keys: each as if it were alone."""
    s = FlatfieldSettings(working_size=6, rounds=8, darkfield=dark)
    want, rows = {}, []
    for scene in (1, 2, 3):
        for c in (1, 2, 3, 7):
            d, _, _ = stack(n=5 + 9 * scene * c, side=6, seed=10 * scene + c)
            d = d + 10 * c
            want[scene, c] = plain_fit(np.sort(d.reshape(len(d), -1), axis=0), 6, s)
            rows += [(scene, c, [float(v) for v in t.ravel()]) for t in d]
    tiles = spark.createDataFrame(rows, "scene int, c int, px array<double>").repartition(5)
    out = SH.estimate_flatfield(tiles, (6, 6), s, keys=("scene", "c")).toPandas().sort_values(["scene", "c", "y", "x"])
    assert len(out) == 12 * 36
    for key, got in out.groupby(["scene", "c"]):
        assert np.allclose(got.flat, want[key][0] / want[key][0].mean()) and np.allclose(got.dark, want[key][1])


def test_dark_field_is_told_from_the_flat_field(spark):
    d, flat, _ = stack(n=60, side=8, seed=4)
    tiles = spark.createDataFrame([(1, [float(v) for v in t.ravel()]) for t in d + 40], "c int, px array<double>")
    s = FlatfieldSettings(working_size=8, darkfield=True)
    out = SH.estimate_flatfield(tiles, (8, 8), s).toPandas().sort_values(["y", "x"])
    assert np.abs(out.flat.to_numpy() - flat.ravel()).max() < 0.1
    assert np.abs(out.dark.to_numpy() - 40).mean() < 8


def field_rows(spark, fields):
    rows = [(c, int(y), int(x), float(f[y, x])) for c, f in fields.items() for y, x in np.ndindex(f.shape)]
    return spark.createDataFrame(rows, "c int, y int, x int, flat double")


def test_base_fluorescence(spark):
    d, flat, level = stack(n=10)
    tiles = spark.createDataFrame([(1, i, [float(v) for v in t.ravel()]) for i, t in enumerate(d)], "c int, t int, px array<double>")
    got = SH.base_fluorescence(tiles, (12, 12), field_rows(spark, {1: flat}), working_size=12).toPandas().sort_values("t")
    assert np.abs(got.base.to_numpy() - level).max() < 2 and got.converged.all()


def test_base_fluorescence_of_all_channels(spark):
    d, flat, level = stack(n=10)
    rows, fields = [], {}
    for c in (1, 3):
        fields[c] = flat if c == 1 else flat[:, ::-1].copy()
        rows += [(c, i, [float(v) * c for v in (t if c == 1 else t[:, ::-1]).ravel()]) for i, t in enumerate(d)]
    kinds = "c int, t int, px array<double>"
    both = SH.base_fluorescence(spark.createDataFrame(rows, kinds), (12, 12), field_rows(spark, fields), working_size=12).collect()
    assert len(both) == 20
    for c, flat in fields.items():
        alone = SH.base_fluorescence(spark.createDataFrame([r for r in rows if r[0] == c], kinds), (12, 12), field_rows(spark, {c: flat}), working_size=12).collect()
        want = {r.t: r.base for r in alone}
        assert all(r.base == pytest.approx(want[r.t], rel=1e-6) for r in both if r.c == c)
    with pytest.raises(Exception, match="no field for channel 3"):
        SH.base_fluorescence(spark.createDataFrame(rows, kinds), (12, 12), field_rows(spark, {1: fields[1]}), working_size=12).collect()


def test_shading_queries_take_every_channel(spark, sf_dir):
    from lumenframe.plans import QUERIES
    from lumenframe.sources import tables as S
    tiles = {(r.c, r.z, r.ty, r.tx) for r in S.tiles(spark, sf_dir).drop("px").collect()}
    got = QUERIES["base_fluorescence"](spark, sf_dir).collect()
    assert len(got) == len(tiles) and {(r.c, r.z, r.ty, r.tx) for r in got} == tiles
    assert QUERIES["chromatic_correct"](spark, sf_dir).count() == S.voxels(spark, sf_dir).count()


def test_radial_background(spark):
    grid = spark.createDataFrame([(1, y, x, float(3 * y + x + 1)) for y in range(3) for x in range(3) if (y, x) != (1, 1)],
                                 "c int, gy int, gx int, background double")
    want = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "c int, gy int, gx int")
    got = {(r["gy"], r["gx"]): r["background"] for r in SH.interpolate_background(grid, want, ["c"]).collect()}
    assert got[(2, 0)] == pytest.approx(7.0) and got[(1, 1)] == pytest.approx(5.0, abs=0.3)


def test_matrices():
    c = cosine_matrix(7)
    assert np.allclose(c @ c.T, np.eye(7))
    assert np.allclose(resize_matrix(8, 3).sum(axis=1), 1) and np.allclose(resize_matrix(5, 5, "cubic"), np.eye(5))


def test_warp_identity_and_shift(spark):
    a = np.arange(2 * 4 * 5).reshape(2, 4, 5)
    v, i = voxels(spark, a), info(spark, 2, 4, 5)
    same = {(r["z"], r["y"], r["x"]): r["v"] for r in CH.warp(v, i, np.eye(3), [0, 0, 0]).collect()}
    assert all(same[k] == a[k] for k in np.ndindex(a.shape))
    half = {(r["z"], r["y"], r["x"]): r["v"] for r in CH.warp(v, i, np.eye(3), [0, 0, 0.5]).collect()}
    assert half[(0, 0, 0)] == 0.5 and half[(0, 0, 4)] == 0.0 and len(half) == a.size


def test_registration_finds_shift(spark):
    zz, yy, xx = np.mgrid[:4, :16, :16]
    f = lambda y, x: 100 + 80 * np.sin(x / 3.0) * np.cos(y / 4.0)
    rows = lambda a: [(int(z), int(y), int(x), float(v)) for z, y, x, v in zip(zz.ravel(), yy.ravel(), xx.ravel(), a.ravel())]
    fixed = spark.createDataFrame(rows(f(yy, xx)), "z int, y int, x int, v double")
    moving = spark.createDataFrame(rows(f(yy - 0.6, xx + 0.4)), "z int, y int, x int, v double")
    m, t = CH.estimate(fixed, moving, info(spark, 4, 16, 16), rounds=3)
    assert abs(t[1] - 0.6) < 0.1 and abs(t[2] + 0.4) < 0.1 and np.allclose(np.diag(m)[1:], 1, atol=0.02)


def classic_tiff(path, pages, bits, order="<"):
    kind = np.dtype(("u1" if bits == 8 else order + "u2"))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    patch = 4
    for a in pages:
        data_at = len(out)
        out += a.astype(kind).tobytes()
        at = len(out)
        struct.pack_into(order + "I", out, patch, at)
        tags = [(256, a.shape[1]), (257, a.shape[0]), (258, bits), (259, 1), (273, data_at), (277, 1), (278, a.shape[0]),
                (279, a.size * kind.itemsize)]
        out += struct.pack(order + "H", len(tags))
        for tag, value in tags:
            out += struct.pack(order + "HHII", tag, 4, 1, value)
        patch = len(out)
        out += struct.pack(order + "I", 0)
    path.write_bytes(bytes(out))


@pytest.mark.parametrize("bits,order", [(8, "<"), (16, "<"), (16, ">")])
def test_tiff_reader(spark, tmp_path, bits, order):
    spark.dataSource.register(TF.MicroTiff)
    a = np.random.default_rng(bits).integers(0, 2 ** bits, (4, 5, 7))
    classic_tiff(tmp_path / "a.tif", a, bits, order)
    load = lambda **o: TF.to_voxels(spark.read.format("microtiff").options(path=str(tmp_path / "a.tif"), **o).load(), channels=2)
    got = {(r["c"], r["z"], r["y"], r["x"]): r["v"] for r in load().collect()}
    assert got == {(p % 2 + 1, p // 2, y, x): int(a[p, y, x]) for p, y, x in np.ndindex(a.shape)}
    assert load(page_start=1, page_end=3, y_start=2, y_end=4, split_bytes=1).count() == 2 * 2 * 7
    meta = TF.image_infos(spark.read.format("microtiff").option("path", str(tmp_path)).option("pixels", "false").load()).first()
    assert (meta["pages"], meta["height"], meta["width"], meta["bits"]) == (4, 5, 7, bits)


def test_tiff_round_trip(spark, tmp_path):
    spark.dataSource.register(TF.MicroTiff)
    a = np.random.default_rng(0).integers(0, 65536, (5, 6, 4))
    v = voxels(spark, a).unionByName(voxels(spark, a + 0, c=2).filter("y <> 3 and z <> 1"))
    TF.write_stacks(v, str(tmp_path), 4, 6, 16, depth=5, slices_per_file=2)
    assert not list(tmp_path.glob("*.tmp"))
    back = TF.to_voxels(spark.read.format("microtiff").option("path", str(tmp_path)).load(), named=True)
    got = {(r["c"], r["z"], r["y"], r["x"]): r["v"] for r in back.collect()}
    assert all(got[(1, z, y, x)] == a[z, y, x] for z, y, x in np.ndindex(a.shape))
    assert got[(2, 0, 3, 0)] == 0 and got[(2, 1, 0, 0)] == 0 and got[(2, 4, 5, 3)] == a[4, 5, 3]
    assert sorted(p.name for p in tmp_path.glob("*.tif"))[0] == "image_ch1_z000000.tif"


def test_tiff_rejects_compression(tmp_path):
    classic_tiff(tmp_path / "c.tif", np.ones((1, 2, 2)), 8)
    raw = bytearray((tmp_path / "c.tif").read_bytes())
    raw[raw.index(struct.pack("<HHII", 259, 4, 1, 1)) + 8] = 5
    (tmp_path / "c.tif").write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        list(TF.pages(str(tmp_path / "c.tif")))


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "1_3"), (1, 4.0, 5.0, 6.0, "low_confidence")],
                              "punctum_id long, x double, y double, z double, final_prediction string")
    PF.write_by_label(p, p.drop("final_prediction"), str(tmp_path / "groups"))
    assert {d.name for d in (tmp_path / "groups").glob("final_*")} == {"final_prediction=1_3", "final_prediction=low_confidence"}
    PF.write_csv(p, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == p.columns
    full = p.withColumns({c: F.lit(1.0) for c in ("score", "radius", "mass", "mean_intensity", "max_intensity", "sd_intensity")}
                         ).withColumn("vol_size", F.lit(3))
    z = lambda legacy: [r["punctum z"] for r in PF.puncta_info(full, legacy).orderBy("`puncta #`").collect()]
    assert z(False) == [3.0, 6.0] and z(True) == [2.0, 5.0]


def test_streaming_row_local(spark, tmp_path):
    voxels(spark, np.arange(8).reshape(1, 2, 4)).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(VOX).parquet(str(tmp_path / "in"))
    out = I.channel_split(s, 1).withColumn("v", I.invert(F.col("v"), 255))
    q = out.writeStream.format("memory").queryName("inverted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("inverted").agg(F.sum("v")).first()[0] == 255 * 8 - 28


def test_crowded_ranking_equals_plain(spark):
    """Two-step ranks with many ties and more pieces than pixels."""
    rng = np.random.default_rng(2)
    px = rng.integers(0, 3, (50, 2)).astype(float)
    px[:, 1] = 7.0
    df = spark.createDataFrame([(1, list(map(float, r))) for r in px], "c int, px array<double>")
    get = lambda flag: [r["px"] for r in SH.order_rows(df, ["c"], flag).orderBy("r").collect()]
    assert get(True) == get(False) == [list(r) for r in np.sort(px, axis=0)]


def test_flatfield_per_scene(spark):
    d, flat, _ = stack(n=20, side=8)
    rows = [(s, c, [float(v) for v in (t * s).ravel()]) for s in (1, 2) for c in (1, 3) for t in d]
    tiles = spark.createDataFrame(rows, "scene int, c int, px array<double>")
    s = FlatfieldSettings(working_size=8, rounds=30)
    out = SH.estimate_flatfield(tiles, (8, 8), s, keys=("scene", "c")).toPandas()
    assert len(out) == 4 * 64 and out.groupby(["scene", "c"]).flat.mean().sub(1).abs().max() < 1e-9


def test_any_channel_number(spark):
    v = voxels(spark, np.ones((1, 2, 2)), c=65)
    got = RL.attach(v, TH.percentile_threshold(v), ["c"]).collect()
    assert len(got) == 4 and {(r["c"], r["v"], r["thr"]) for r in got} == {(65, 1, 1.0)}
