"""Imports every operator, which registers its query."""

from lumenframe.llm import (  # noqa: F401
    bpe,
    chunks,
    exact,
    fingerprints,
    near,
    negatives,
    packing,
    phrases,
    pii,
    quality,
    shards,
    urls,
    warc,
)
from lumenframe.llm.catalog import ORACLES, QUERIES  # noqa: F401
