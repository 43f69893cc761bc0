"""All registered queries; importing the plan modules fills the registry."""

from tidemark.plans import aggregates, core, features, filings, more, quality, research, streams
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "core", "features", "filings", "more", "quality", "research", "streams"]
