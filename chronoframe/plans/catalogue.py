"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from chronoframe.plans import density, detection, evaluation, frames, geometry, lines, motion, points, quarantine, records, regions, relational, scenes, segments, series, texts, tracking, vectors, voting  # noqa: F401
from chronoframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
