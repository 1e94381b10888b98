"""Tree ensembles as expressions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import ensemble
from lumenframe.plans import classification as P


def random_tree(rng, names, depth):
    if depth == 0 or rng.random() < 0.2:
        return {"value": round(rng.uniform(-2, 2), 3)}
    node = {"feature": rng.choice(names), "threshold": rng.randrange(10), "left": random_tree(rng, names, depth - 1), "right": random_tree(rng, names, depth - 1)}
    return node | ({"missing": "right"} if rng.random() < 0.5 else {})


def plain(model, vector):
    total = model["base"]
    for tree in model["trees"]:
        node = tree["root"]
        while "value" not in node:
            v = vector[model["features"].index(node["feature"])]
            absent = v is None or math.isnan(v)
            node = node[node.get("missing", "left")] if absent else node["left"] if v <= node["threshold"] else node["right"]
        total += tree.get("weight", 1.0) * node["value"]
    return total if model["link"] == "identity" else 1 / (1 + math.exp(-total))


@pytest.mark.parametrize("link", ["identity", "logistic"])
def test_random_ensembles(spark, link):
    rng = random.Random(7)
    names = ["a", "b", "c", "d"]
    model = {"features": names, "base": 0.3, "link": link, "trees": [{"weight": rng.uniform(0, 1), "root": random_tree(rng, names, 4)} for _ in range(6)]}
    vectors = [[rng.choice([None, float("nan"), *map(float, range(10))]) for _ in names] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", ensemble.score(json.dumps(model), F.col("v")).alias("s")).collect()}
    assert all(got[i] == pytest.approx(plain(model, v)) for i, v in enumerate(vectors))


def test_fallback_and_errors(spark):
    model = {"features": ["a"], "base": 1.0, "link": "identity", "trees": []}
    vectors = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0, 2.0])], "punctum_id long, features array<double>")
    scores = spark.createDataFrame([(i, 0.25) for i in (1, 2, 3, 4)], "punctum_id long, score double")
    got = {r["punctum_id"]: r["p"] for r in P.ensemble_probability(vectors, model)(scores).collect()}
    assert got == {1: 1.0, 2: 0.25, 3: 0.25, 4: 0.25}
    hard = {r["punctum_id"]: r["p"] for r in P.ensemble_probability(vectors, model, hard_labels=True)(scores).collect()}
    assert hard[1] == 0.25
    with pytest.raises(ValueError):
        ensemble.score(model | {"link": "probit"}, F.col("features"))
    with pytest.raises(ValueError):
        ensemble.score(model | {"trees": [{"root": {"feature": "z", "threshold": 1, "left": {"value": 1}, "right": {"value": 2}}}]}, F.col("features"))
