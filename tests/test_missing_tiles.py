"""Images whose last slice lacks tiles, sums in tile order, and work done once per region."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.model import ClassifySettings
from lumenframe.operators import classify as K
from lumenframe.operators import enhance as E
from lumenframe.operators import image as I
from lumenframe.operators import metrics as Q
from lumenframe.operators import overlap as O
from lumenframe.operators import roi as R
from lumenframe.plans import classification as P
from lumenframe.plans.catalog import r6
from lumenframe.sources import tables as S

VOX = "c int, z int, y int, x int, v int"


def plane(side=16, keep=lambda y, x: True, v=7):
    return [(1, 0, y, x, v) for y in range(side) for x in range(side) if keep(y, x)]


def test_ssim_of_a_slice_without_a_tile(spark):
    rows = [(c, z, y, x, (y * 7 + x * 3) % 50, (y * 5 + x) % 50) for _, z, y, x, _ in plane(keep=lambda y, x: y < 8 or x < 8) for c in (1,)]
    df = spark.createDataFrame(rows, "c int, z int, y int, x int, a int, b int")
    assert Q.ssim(df, block=8).first().ssim is None            # no full window: failed with a division by zero
    whole = spark.createDataFrame([(1, 0, y, x, (y * 7 + x * 3) % 50 * (y < 8 or x < 8), (y * 5 + x) % 50 * (y < 8 or x < 8)) for _, _, y, x, _ in plane()],
                                  "c int, z int, y int, x int, a int, b int")
    assert abs(Q.ssim(df, block=8, shape=(16, 16)).first().ssim - Q.ssim(whole, block=8).first().ssim) < 1e-12


@pytest.mark.parametrize("slots", [4, 17])
def test_stitch_adds_in_tile_order(spark, slots):
    values = [1e16, 1.0, 1.0, -1e16]                           # another order gives another sum
    for order in ((0, 1, 2, 3), (3, 0, 2, 1), (1, 2, 3, 0)):
        df = spark.createDataFrame([(1, 0, 0, 0, k, values[k]) for k in order], "c int, z int, y int, x int, slot int, v double").repartition(3)
        r = I.stitch(df, slots=slots).first()
        assert r.v == (((0.0 + values[0]) + values[1]) + values[2] + values[3]) / 4 and r.coverage == 4


def test_slots_follow_the_tiles(spark):
    tiles = spark.createDataFrame([(1, 0, ty, tx, [0] * 64) for ty in (0, 1, 2) for tx in (0, 1, 2)], "c int, z int, ty int, tx int, px array<int>")
    slot, n = I.tile_slot(F.floor(F.col("_i") / 8), F.col("_i") % 8, 8, 8, 6)
    at = S.unfold(tiles.select("*", F.struct("ty", "tx").alias("t")), 6, slot=slot)
    per = at.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("slot", "t"))).alias("l")).collect()
    assert n == 4 and all([e.t for e in r.l] == sorted(e.t for e in r.l) and len({e.slot for e in r.l}) == len(r.l) for r in per)


def test_padding_fills_missing_tiles(spark):
    info = spark.createDataFrame([(2, 70, 70)], "depth int, height int, width int")
    v = spark.createDataFrame([(1, 0, y, x, 1) for y in range(70) for x in range(70) if y < 8 or x != 65], VOX)
    out = I.pad_to_multiple(v, info, [1, 2])
    assert out.count() == 2 * 2 * 72 * 72 == out.dropDuplicates(["c", "z", "y", "x"]).count()
    assert out.agg(F.sum("v")).first()[0] == 70 * 70 - 62
    out = I.pad_to(v, info, [1], height=74, width=60)
    assert out.count() == 2 * 74 * 60 == out.dropDuplicates(["z", "y", "x"]).count()


@pytest.mark.parametrize("kind", ["linear", "cubic"])
def test_resize_has_outputs_that_no_voxel_reaches(spark, kind):
    v = spark.createDataFrame(plane(keep=lambda y, x: x < 8), VOX)
    rows = I.resize(v, {"x": (16, 20)}, kind).withColumn("v", r6("v")).collect()
    assert len(rows) == 16 * 20
    assert all(abs(r.v - 7) < 1e-9 for r in rows if r.x < 10) and all(math.isnan(r.v) for r in rows if r.x > 12)


def test_regions_are_worked_out_once(spark):
    puncta = spark.createDataFrame([(i, 3 + i % 2, 4, 1, [(3 + i % 2 + a, 4 + b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for i in range(40)],
                                   "punctum_id long, x int, y int, z int, voxels array<struct<x:int,y:int,z:int>>")
    info = spark.createDataFrame([(3, 16, 16)], "depth int, height int, width int")
    mask = spark.createDataFrame([(c, z, y, x, 9) for c in (1, 3) for z in range(3) for y in range(16) for x in range(16) if (y * x + c + z) % 3], VOX)
    rois = R.roi(puncta, info)
    regions = R.regions(rois)
    assert regions.count() == 2
    one = {r.punctum_id: r for r in P.per_punctum(R.roi_masks(mask, rois)).collect()}
    two = {r.punctum_id: r for r in R.to_puncta(P.per_punctum(R.roi_masks(mask, regions)), rois).collect()}
    assert one == two and len(two) == 40
    answers = P.Answers(puncta.filter("punctum_id % 4 > 0").select("punctum_id", (F.col("punctum_id") / 50).alias("_m")))
    each = {r.punctum_id: r.pairs for r in answers.on_puncta(R.to_puncta(P.per_punctum(R.roi_masks(mask, regions)), rois)).collect()}
    want = {r.punctum_id: r.pairs for r in P.per_punctum(R.roi_masks(mask, rois), answers).collect()}
    assert each == want


@pytest.mark.parametrize("hard", [False, True])
def test_a_decision_is_made_once_per_region_and_answer(spark, hard):
    puncta = spark.createDataFrame([(i, 3 + i % 2, 4, 1, [(3 + i % 2 + a, 4 + b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for i in range(60)],
                                   "punctum_id long, x int, y int, z int, voxels array<struct<x:int,y:int,z:int>>")
    info = spark.createDataFrame([(3, 16, 16)], "depth int, height int, width int")
    mask = spark.createDataFrame([(c, z, y, x, 9) for c in (1, 3, 5) for z in range(3) for y in range(16) for x in range(16) if (y * x + c + z) % 3], VOX)
    rois, settings = R.roi(puncta, info), ClassifySettings(use_axon_dendrite=False, post_cell_channel=None)
    given = [(i, (None, float("nan"), 0.0, 1.0, 0.3, 0.9)[i % 6]) for i in range(60) if i % 5]
    answers = P.Answers(spark.createDataFrame(given, "punctum_id long, _m double"), hard)
    per = P.per_punctum(R.roi_masks(mask, R.regions(rois)))
    got = {r.punctum_id: r for r in answers.predict(per, rois, settings).collect()}
    want = {r.punctum_id: r for r in K.predict(answers.on_puncta(R.to_puncta(per, rois)), settings).collect()}
    assert got == want and len(got) == 60 and len({r.final_confidence for r in got.values()}) > 2


def test_a_crowd_at_one_spot_is_unfolded_once(spark):
    puncta = spark.range(3000).select(F.col("id").alias("punctum_id"), F.lit(4).alias("x"), F.lit(4).alias("y"), (F.col("id") % 2).cast("int").alias("z"))
    info = spark.createDataFrame([(1, 16, 16)], "depth int, height int, width int")
    neurites = spark.createDataFrame([(0, 4, 4, 1, 0), (0, 5, 6, 1, 1)], "z int, y int, x int, is_axon int, is_dendrite int")
    out = R.local_neurites(puncta, neurites, info)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan                               # the unfolded positions are done and handed back by then
    got = {(r.axon_overlap, r.local_axon_density, r.local_dendrite_density): r["count"] for r in
           out.groupBy("axon_overlap", "local_axon_density", "local_dendrite_density").count().collect()}
    assert got == {(1.0, 2 / 25, 1 / 25): 1500, (0.0, 0.0, 0.0): 1500}


def test_boxed_puncta_have_the_boxes_of_their_voxels(spark, sf_dir):
    box = lambda boxed: {tuple(r) for r in R.boxes(S.puncta(spark, sf_dir, boxed)).collect()}
    assert box(True) == box(False)


def test_equalisation_makes_tables_once_and_skips_missing_tiles(spark):
    rows = [(1, 0, y, x, (y * 37 + x * 11) % 256) for _, _, y, x, _ in plane(keep=lambda y, x: y < 8 or x < 8)]
    out = E.equalize_tiles(spark.createDataFrame(rows, VOX), 16, 16, clip=40.0, grid=(5, 5))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()                                        # 36 pixels border a tile that has none: their value was null or of a wrong tile
    assert len(got) == 156 and all(0 <= r.v <= 255 for r in got)
    whole = E.equalize_tiles(spark.createDataFrame([(1, 0, y, x, (y * 37 + x * 11) % 256) for _, _, y, x, _ in plane()], VOX), 16, 16, clip=40.0, grid=(5, 5))
    want = {(r.y, r.x): r.v for r in whole.collect()}
    assert len(want) == 256 and all(r.v == want[r.y, r.x] for r in got)
