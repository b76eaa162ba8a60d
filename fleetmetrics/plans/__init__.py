"""Registered queries, each next to the SQL that has to give the same rows."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import alerting, dictionary, fleet, grouping, joining, ranges, reporting, scalars, scaled, selecting, snapshots, streams, timed  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
