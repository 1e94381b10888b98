"""Results that must not depend on channel numbers, scenes, batches or one task."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.model import ThresholdSettings
from lumenframe.operators import classify as K
from lumenframe.operators import detection as DT
from lumenframe.operators import enhance as E
from lumenframe.operators import image as I
from lumenframe.operators import relational as RL
from lumenframe.operators import shading as SH
from lumenframe.operators import thresholds as TH
from test_classify import brute


def test_cliques_of_any_channel_numbers(spark):
    rng = np.random.default_rng(6)
    channels = (1, 4, 6, 7, 8, 9, 40)
    rows, want = [], {}
    for i in range(120):
        edges = {q: float(rng.integers(1, 40) / 40) for q in combinations(channels, 2) if rng.random() < 0.6}
        rows.append((i, list(channels), [(a, b, p) for (a, b), p in sorted(edges.items())]))
        want[i] = brute(edges, channels)
    df = spark.createDataFrame(rows, "punctum_id long, chans array<int>, edges array<struct<c1:int,c2:int,p:double>>")
    for r in K.with_best_clique(df).collect():
        w, b = want[r["punctum_id"]], r["best"]
        assert (b is None) == (w is None)
        assert w is None or (b["nsize"] == w[0] and abs(b["nprob"] - w[1]) < 1e-9 and b["label"] == w[2])


def test_two_scenes_keep_their_fields(spark):
    rows = [(s, 1, 0, 0, y, x, y, x, 100.0) for s in (1, 2) for y in (0, 1) for x in (0, 1)]
    v = spark.createDataFrame(rows, "scene int, c int, z int, t int, y int, x int, ly int, lx int, v double")
    field = spark.createDataFrame([(s, 1, y, x, f, d) for s, f, d in ((1, 1.0, 0.0), (2, 0.5, 10.0)) for y in (0, 1) for x in (0, 1)],
                                  "scene int, c int, y int, x int, flat double, dark double")
    got = {(r.scene, r.v) for r in SH.correct_shading(v, field, 65535, ("scene", "c")).collect()}
    assert got == {(1, 100), (2, 180)}
    tiles = spark.createDataFrame([(1, 1, [100, 65535, 7, 8]), (2, 1, [100, 65535, 7, 8]), (3, 1, [1, 2, 3, 4])], "scene int, c int, px array<int>")
    got = {r.scene: r.px for r in SH.correct_tiles(tiles, field, 65535).collect()}
    assert got == {1: [100.0, 65535.0, 7.0, 8.0], 2: [180.0, 65535.0, -6.0, -4.0], 3: [1.0, 2.0, 3.0, 4.0]}


def test_base_fluorescence_ignores_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.uniform(50, 200) + rng.normal(0, 5, 64)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, px array<double>").coalesce(1).withColumn("c", F.lit(1))
    field = spark.range(64).select(F.lit(1).alias("c"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.lit(1.0).alias("flat"))
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", None
    before = spark.conf.get(key)
    out = []
    try:
        for n in ("1", "10000"):
            spark.conf.set(key, n)
            out.append({r.id: (r.base, r.converged) for r in SH.base_fluorescence(df, (8, 8), field, working_size=8).collect()})
    finally:
        spark.conf.set(key, before)
    assert all(abs(out[0][i][0] - out[1][i][0]) < 1e-9 and out[0][i][1] for i in out[0])


def test_lookup_by_any_channel(spark):
    v = spark.createDataFrame([(1, 1.0), (65, 2.0), (None, 3.0)], "c int, v double")
    got = RL.attach(v, spark.createDataFrame([(65, 9.0), (None, 8.0)], "c int, w double"), ["c"], "left").collect()
    assert sorted((r.v, r.w) for r in got if r.c) == [(1.0, None), (2.0, 9.0)] and len(got) == 3


def test_padding_and_gaps_spread(spark):
    info = spark.createDataFrame([(6, 5, 5)], "depth int, height int, width int")
    v = spark.range(6 * 25).select(F.lit(1).alias("c"), F.floor(F.col("id") / 25).cast("int").alias("z"),
                                   F.floor(F.col("id") % 25 / 5).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("x"), F.lit(1.0).alias("v"))
    out = I.pad_to(v, info, [1], depth=8, height=9, width=7)
    assert out.count() == 8 * 9 * 7 == out.dropDuplicates(["c", "z", "y", "x"]).count() and out.agg(F.sum("v")).first()[0] == 150
    assert I.pad_to(v, info, [1], depth=2, height=3, width=4).count() == 24
    parts = out.filter("v = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 2


@pytest.mark.parametrize("parts", ["2", "16"])
def test_positions_in_a_hot_folder(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.range(500).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "b").alias("folder"), F.format_string("%04d", 500 - F.col("id")).alias("name"))
        rows = RL.ranked(df, ["folder"], ["name"], "z").collect()
        for f in ("hot", "b", None):
            mine = sorted((r.name, r.z) for r in rows if r.folder == f)
            assert [z for _, z in mine] == list(range(len(mine))) and mine
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_far_regions_stay_apart(spark):
    rows = [(z, y, x, 5) for z, y, x in ((0, 0, 5_000_000), (0, 1, 5_000_000), (0, 2, 0), (600_000, 0, 1), (0, 1, 805_696))]
    mask = spark.createDataFrame(rows, "z int, y int, x int, v int")
    assert DT.label_volume(mask).select("label").distinct().count() == 4


def test_slices_stay_apart_and_empty_channels_have_a_threshold(spark):
    v = spark.createDataFrame([(c, z, 0, 0, c * 10 + z) for c in (1, 2) for z in (0, 1)], "c int, z int, y int, x int, v int")
    assert sorted((r.z, r.px) for r in I.channels_last(v).collect()) == [(0, [10, 20]), (1, [11, 21])]
    out = TH.adaptive_threshold(v, ThresholdSettings(), wanted=spark.createDataFrame([(1,), (2,), (3,)], "c int"))
    assert {r.c: r.thr for r in out.collect()}[3] == 0.0


def test_equalisation_pads_both_axes_or_none():
    assert E._padding(16, 16, (4, 4)) == (0, 0) and E._padding(16, 18, (4, 4)) == (4, 2) and E._padding(15, 13, (4, 5)) == (1, 2)
