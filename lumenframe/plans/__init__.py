"""Registered queries and end-to-end jobs."""

from lumenframe.plans import queries_features, queries_image, queries_puncta, queries_shading  # noqa: F401
from lumenframe.plans.catalog import ORACLES, QUERIES  # noqa: F401
