"""Label decisions on hand-made puncta."""

from itertools import combinations

import numpy as np
import pytest

from lumenframe.model import ClassifySettings, pixel_type, validate_channels
from lumenframe.operators import classify as K
from lumenframe.operators import roi as R
from lumenframe.plans import classification as P

TYPE = ("punctum_id long, chans array<int>, pairs array<struct<c1:int,c2:int,p:double>>, "
        "axon_cov double, dendrite_cov double")


def decide(spark, cases, settings=ClassifySettings()):
    rows = [(i, list(ch), [(a, b, float(p)) for (a, b), p in sorted(pr.items())], ax, de)
            for i, (ch, pr, ax, de) in enumerate(cases)]
    puncta = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(len(rows) + 1)],
                                   "punctum_id long, x double, y double, z double")
    out = K.classify(puncta, spark.createDataFrame(rows, TYPE), settings).collect()
    got = {r["punctum_id"]: (r["final_prediction"], round(r["final_confidence"], 6)) for r in out}
    assert got.pop(len(rows)) == ("low_confidence", 0.0)  # a punctum without any channel
    return [got[i] for i in range(len(rows))]


def test_single_channels(spark):
    got = decide(spark, [([2], {}, None, None), ([5], {}, None, None), ([1], {}, None, None), ([3], {}, None, None)])
    assert got == [("low_confidence", 0.0), ("low_confidence", 0.0), ("1", 0.8), ("3", 0.8)]


def test_pairs_and_triples(spark):
    got = decide(spark, [
        ([1, 3], {(1, 3): 0.7}, None, None),
        ([1, 3], {(1, 3): 0.5}, None, None),                      # below 0.6: first isolated channel
        ([2, 3], {(2, 3): 0.59}, None, None),                     # ... which is rejected here
        ([1, 3, 5], {(1, 3): 0.7, (1, 5): 0.1, (3, 5): 0.2}, None, None),
        ([1, 3, 5], {(1, 3): 0.1, (1, 5): 0.1, (3, 5): 0.2}, None, None),
        ([1, 5], {(1, 5): 0.0}, None, None),                      # nil overlap: channel 5 is dropped
    ])
    assert got == [("1_3", 0.7), ("1", 0.8), ("low_confidence", 0.0), ("1_3_5", round(1 / 3, 6)),
                   ("3_5", 0.2), ("1", 0.0)]


def test_channel2_skip_and_thresholds(spark):
    pairs = {(1, 2): 0.95}
    got = decide(spark, [([1, 2], pairs, 0.1, 0.9), ([1, 2], pairs, 0.3, 0.9), ([1, 2], pairs, 0.1, 0.8)])
    assert [g[0] for g in got] == ["1", "1_2", "1_2"]
    model = ClassifySettings(optimal_threshold=0.8)
    got = decide(spark, [([1, 2], {(1, 2): 1.1}, None, None), ([1, 3], {(1, 3): 0.7}, None, None)], model)
    assert [g[0] for g in got] == ["1", "1"]
    cut = ClassifySettings(confidence_threshold=0.75)
    assert decide(spark, [([1, 3], {(1, 3): 0.7}, None, None)], cut) == [("low_confidence", 0.7)]


def brute(edges, nodes):
    best = None
    weak = {4, 5} & set(nodes)
    for k in range(2, len(nodes) + 1):
        for s in combinations(nodes, k):
            ps = [edges.get(q) for q in combinations(s, 2)]
            if any(p is None for p in ps):
                continue
            bonus = bool(weak & set(s))
            key = (-(k + 0.5 * bonus), -(np.mean(ps) + 0.3 * bonus), "_".join(map(str, s)))
            best = min(best, key) if best else key
    return best


def test_best_clique_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i in range(300):
        edges = {q: float(rng.integers(1, 40) / 40) for q in combinations(range(1, 6), 2) if rng.random() < 0.6}
        rows.append((i, [1, 2, 3, 4, 5], [(a, b, p) for (a, b), p in sorted(edges.items())]))
        want[i] = brute(edges, (1, 2, 3, 4, 5))
    df = spark.createDataFrame(rows, "punctum_id long, chans array<int>, edges array<struct<c1:int,c2:int,p:double>>")
    for r in K.with_best_clique(df).collect():
        w, b = want[r["punctum_id"]], r["best"]
        assert (b is None) == (w is None)
        if w:
            assert b["nsize"] == w[0] and abs(b["nprob"] - w[1]) < 1e-9 and b["label"] == w[2]


def test_roi_is_asymmetric_and_clamped(spark):
    vox = [(x, y, 3) for y in range(10, 13) for x in range(20, 23)]
    rows = [(0, 21.0, 11.0, 3.0, vox), (1, 0.0, 0.0, 99.0, [(0, 0, 99)])]
    p = spark.createDataFrame(rows, "punctum_id long, x double, y double, z double, voxels array<struct<x:int,y:int,z:int>>")
    info = spark.createDataFrame([(10, 64, 64)], "depth int, height int, width int")
    got = {r["punctum_id"]: r for r in R.roi(p, info).collect()}
    assert (got[0]["x1"], got[0]["x2"], got[0]["y1"], got[0]["y2"]) == (15, 27, 5, 17)
    assert (got[1]["x1"], got[1]["x2"], got[1]["z_sample"]) == (0, 5, 9)
    assert {r["punctum_id"] for r in R.usable(R.roi(p, info)).collect()} == {0}


def test_roi_join_brute_force(spark):
    """A crowd on one spot and boxes over several blocks."""
    rng = np.random.default_rng(1)
    img = rng.random((3, 40, 40))
    mask = spark.createDataFrame([(1, int(z), int(y), int(x), float(img[z, y, x])) for z, y, x in zip(*np.nonzero(img > 0.9))],
                                 "c int, z int, y int, x int, v double")
    spots = [(i, 17, 15, 1) for i in range(30)] + [(30 + i, int(rng.integers(40)), int(rng.integers(40)), int(rng.integers(-1, 4)))
                                                  for i in range(30)]
    p = spark.createDataFrame([(i, float(x), float(y), float(z), 9, max(x - 1, 0), min(x + 1, 39), max(y - 1, 0), min(y + 1, 39))
                               for i, x, y, z in spots],
                              "punctum_id long, x double, y double, z double, n_voxels int, x_min int, x_max int, y_min int, y_max int")
    info = spark.createDataFrame([(3, 40, 40)], "depth int, height int, width int")
    got = {(r["punctum_id"], r["z"], r["y"], r["x"]) for r in R.roi_masks(mask, R.roi(p, info)).collect()}
    want = set()
    for i, x, y, z in spots:
        x1, x2 = max(0, max(x - 1, 0) - 5), min(40, min(x + 1, 39) + 5)
        y1, y2 = max(0, max(y - 1, 0) - 5), min(40, min(y + 1, 39) + 5)
        for zz in range(max(z - 1, 0), min(z + 1, 2) + 1):
            want |= {(i, zz, yy, xx) for yy in range(y1, y2) for xx in range(x1, x2) if img[zz, yy, xx] > 0.9}
    assert got == want


def test_model_probability(spark, sf_dir):
    feats = spark.createDataFrame([(1, [0.0] * 99), (2, [1.0] * 99)], "punctum_id long, features array<double>")
    scores = spark.createDataFrame([(1, 1, 3, 0.25), (2, 1, 3, 0.5), (3, 1, 3, 0.75)],
                                   "punctum_id long, c1 int, c2 int, score double")
    run = lambda f, **k: {r["punctum_id"]: r["p"] for r in P.model_probability(feats, f, **k)(scores).collect()}
    assert run(lambda x: 0.1 + 0.8 * x[:, 0]) == pytest.approx({1: 0.1, 2: 0.9, 3: 0.75})
    assert run(lambda x: x[:, 0], hard_labels=True) == {1: 0.25, 2: 0.5, 3: 0.75}

    def broken(_):
        raise RuntimeError("no model")
    assert run(broken) == {1: 0.25, 2: 0.5, 3: 0.75}


def test_channel_roles():
    assert P.left_out(ClassifySettings()) == [4]
    assert P.left_out(ClassifySettings(use_axon_dendrite=False)) == [4, 2]
    with pytest.raises(ValueError):
        P.left_out(ClassifySettings(post_cell_channel=4))
    with pytest.raises(ValueError):
        validate_channels([0], 3)
    assert validate_channels(None, 3) == [1, 2, 3]
    assert pixel_type("i", 4, 200) == "uint8" and pixel_type("f", 4, 300) == "uint16"
    with pytest.raises(ValueError):
        pixel_type("O", 8, 1)


def test_negative_threshold_empty_plane(spark):
    rm = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 0, 3)], "punctum_id long, c int, z int, v int")
    assert [r["c"] for r in R.detected_channels(rm).collect()] == [2]
