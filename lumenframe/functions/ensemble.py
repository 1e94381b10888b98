"""Tree ensembles as JSON, compiled to one column expression.

A model is a dictionary (or its JSON text):

    {"features": ["mass", ...], "base": 0.0, "link": "identity" or "logistic",
     "trees": [{"weight": 1.0, "root": node}, ...]}

A node is {"value": number}, or {"feature": name, "threshold": number, "left":
node, "right": node, "missing": "left" or "right"}: values up to the threshold
go left, a null or NaN goes where ``missing`` says (left by default). The sum
of base and weighted tree values passes the link. Being an expression, the
model is scored inside the scan; nothing is unpickled and no worker loads it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _walk(node: Mapping, values: Mapping[str, Column]) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    if node["feature"] not in values:
        raise ValueError(f"the model has no feature {node['feature']!r}")
    v = values[node["feature"]]
    left, right = _walk(node["left"], values), _walk(node["right"], values)
    absent = v.isNull() | F.isnan(v)
    aside = {"left": left, "right": right}[node.get("missing", "left")]
    return F.when(absent, aside).when(v <= F.lit(float(node["threshold"])), left).otherwise(right)


def score(model: Mapping | str, vector: Column) -> Column:
    """The model's answer for an array of its features in their order; null for a null array or one of another length."""
    model = json.loads(model) if isinstance(model, str) else model
    names = list(model["features"])
    values = {n: F.get(vector, F.lit(i)).cast("double") for i, n in enumerate(names)}
    total = F.lit(float(model.get("base", 0.0)))
    for tree in model["trees"]:
        total = total + F.lit(float(tree.get("weight", 1.0))) * _walk(tree["root"], values)
    link = model.get("link", "identity")
    if link not in ("identity", "logistic"):
        raise ValueError(f"unknown link {link!r}")
    answer = total if link == "identity" else 1.0 / (1.0 + F.exp(-total))
    return F.when(F.size(vector) == len(names), answer)
