"""Masks, components, skeletons and bit words against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import raster
from lumenframe.functions import words as W
from lumenframe.operators import components as C
from lumenframe.operators import masks as M
from lumenframe.operators import overlap as O
from lumenframe.operators import skeleton as SK


def pixels(spark, mask, c=1, z=0):
    rows = [(c, z, int(y), int(x), 1) for y, x in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "c int, z int, y int, x int, v int")


def as_set(df):
    return {(r["y"], r["x"]) for r in df.collect()}


def cross(mask, grow):
    p = np.pad(mask, 1)
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


def points(mask):
    return {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}


def info(spark, h, w, d=1):
    return spark.createDataFrame([(d, h, w)], "depth int, height int, width int")


def test_erode_dilate_small(spark):
    m = np.zeros((5, 5), bool)
    m[1:4, 1:4] = True
    df = pixels(spark, m)
    assert as_set(M.erode(df)) == {(2, 2)}
    assert as_set(M.dilate(df, info(spark, 5, 5))) == points(cross(m, True))
    assert as_set(M.perimeter(df)) == points(m) - {(2, 2)}


def test_border_counts_as_background(spark):
    m = np.ones((4, 4), bool)
    assert as_set(M.erode(pixels(spark, m))) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert as_set(M.dilate(pixels(spark, m), info(spark, 4, 4))) == points(m)


def _scores(a, b):
    js, ds = [], []
    for p, q in ((cross(a, False), cross(b, False)), (a, b), (cross(a, True), cross(b, True))):
        union = (p | q).sum()
        if union:
            js.append((p & q).sum() / union)
            ds.append(2 * (p & q).sum() / (p.sum() + q.sum()))
    return (np.mean(js), np.std(js), np.mean(ds)) if js else (0.0, 0.0, 0.0)


@pytest.mark.parametrize("shape", [(5, 7), (3, 62), (4, 63), (6, 130), (2, 125)])
def test_multiscale_any_width(spark, shape):
    """Strips of 62 pixels must not show in the result."""
    rng = np.random.default_rng(shape[1])
    a, b = rng.random(shape) < 0.7, rng.random(shape) < 0.7
    rows = [(9, 0, shape[1], 0, shape[0], 0, c, 0, int(y), int(x), 5)
            for c, m in ((1, a), (3, b)) for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "punctum_id long, x1 int, x2 int, y1 int, y2 int, dz int, c int, z int, "
                                     "y int, x int, v int")
    r = O.overlap_scores(df).first()
    j, sd, d = _scores(a, b)
    assert np.allclose([r["jacc_mean"], r["jacc_std"], r["dice_mean"], r["score"]], [j, sd, d, (j + d) / 2])


def test_erased_mask_scale_is_skipped(spark):
    a = np.zeros((4, 4), bool)
    a[1, 1] = True
    rows = [(1, 0, 4, 0, 4, 0, c, 0, 1, 1, 5) for c in (1, 2)]
    df = spark.createDataFrame(rows, "punctum_id long, x1 int, x2 int, y1 int, y2 int, dz int, c int, z int, "
                                     "y int, x int, v int")
    assert O.overlap_scores(df).first()["jacc_mean"] == 1.0


def test_only_shared_slices_count(spark):
    rows = [(1, 0, 4, 0, 4, -1, 1, 4, 1, 1, 5), (1, 0, 4, 0, 4, 0, 1, 5, 2, 2, 5), (1, 0, 4, 0, 4, 0, 2, 5, 2, 2, 5),
            (2, 0, 4, 0, 4, -1, 1, 4, 1, 1, 5), (2, 0, 4, 0, 4, 1, 2, 6, 1, 1, 5), (3, 0, 4, 0, 4, 0, 5, 5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "punctum_id long, x1 int, x2 int, y1 int, y2 int, dz int, c int, z int, "
                                     "y int, x int, v int")
    got = {r["punctum_id"]: r for r in O.overlap_scores(df).collect()}
    assert got[1]["n_shared"] == 1 and got[1]["score"] == 1.0
    assert got[2]["n_shared"] == 0 and got[2]["score"] == 0.0
    assert 3 not in got  # its only plane has maximum 0


def test_word_count_ignores_halo(spark):
    df = spark.range(1).select(W.frame(F.lit(2), F.lit(100)).alias("w"))
    assert df.select(W.count(F.col("w"))).first()[0] == 200


def test_diagonal_connectivity(spark):
    m = np.eye(2, dtype=bool)
    df = pixels(spark, m)
    labels = lambda n: {r["label"] for r in C.label_components(df, connectivity=n).collect()}
    assert len(labels(8)) == 1 and len(labels(4)) == 2


def flood(mask, eight):
    out, seen = {}, set()
    for start in sorted(points(mask)):
        if start in seen:
            continue
        todo = [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            out[(y, x)] = start[0] * (1 << 32) + start[1]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if (eight or abs(dy) + abs(dx) == 1) and q not in seen and 0 <= q[0] < mask.shape[0] \
                            and 0 <= q[1] < mask.shape[1] and mask[q]:
                        seen.add(q)
                        todo.append(q)
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_components_across_blocks(spark, eight):
    rng = np.random.default_rng(3)
    m = rng.random((23, 31)) < 0.55
    m[10, :] = True
    got = C.label_components(pixels(spark, m), connectivity=8 if eight else 4, block=4)
    assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == flood(m, eight)


def test_spiral_across_blocks(spark):
    """One component that winds through many blocks: a long chain for the contraction."""
    m = np.zeros((25, 25), bool)
    top, left, bottom, right = 0, 0, 24, 24
    while top <= bottom and left <= right:
        m[top, left:right + 1] = m[top:bottom + 1, right] = m[bottom, left:right + 1] = True
        m[top + 2:bottom + 1, left] = True
        if top + 2 <= bottom and left + 1 <= right:
            m[top + 2, left:left + 2] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    got = C.label_components(pixels(spark, m), connectivity=4, block=3)
    assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == flood(m, False)


def test_thickness_classes(spark):
    """6 +- 0.5 rule: 5.5 is axon, 6.0 both, 6.5 just under the dendrite bound, 7.0 dendrite."""
    side = 10
    rows = []
    for i, area in enumerate((55, 60, 65, 70)):
        rows.append((i, area, 0, side - 1, 0, side - 1))
    df = spark.createDataFrame(rows, "label long, area long, y_min int, y_max int, x_min int, x_max int")
    got = {r["label"]: (r["is_axon"], r["is_dendrite"]) for r in C.with_kind(df).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 1), 3: (0, 1)}


def test_thin_shapes():
    bar = np.zeros((7, 12), np.uint8)
    bar[2:5, 1:11] = 1
    out = raster.thin_canvas(bar)
    assert out.sum() > 0 and (out <= bar).all() and set(np.nonzero(out)[0]) == {3}
    line = np.zeros((3, 6), np.uint8)
    line[1] = 1
    assert (raster.thin_canvas(line) == line).all()


def test_skeleton_blocks_equal_whole(spark):
    rng = np.random.default_rng(5)
    m = np.kron(rng.random((6, 6)) < 0.6, np.ones((7, 7))).astype(bool)
    df = pixels(spark, m)
    whole = points(raster.thin_canvas(m.astype(np.uint8)) == 1)
    assert as_set(SK.skeletonize_local(df, ["c", "z"])) == whole
    assert as_set(SK.skeletonize_blocks(df, ["c", "z"], block=10, rounds=2)) == whole


def test_labels_of_a_batch_stay_apart():
    group = np.array([0, 0, 1, 1, 2])
    y, x = np.array([0, 0, 0, 0, 0]), np.array([0, 1, 1, 5, 2])
    assert list(raster.component_labels(group, y, x, 8)) == [0, 0, 2, 3, 4]
