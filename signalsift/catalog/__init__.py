"""All registered queries."""

from signalsift.catalog import curation, quality, scoring, streams, windows
from signalsift.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation", "quality", "scoring", "streams", "windows"]
