"""All registered queries of the detection, tracking and dataset operators, with their SQL."""

from __future__ import annotations

from fieldlens.plans import boxes, datasets, evaluation, exports, geometry, mapping, metrics, names, storage, streams, tracking  # noqa: F401  they register themselves
from fieldlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
