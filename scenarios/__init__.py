"""Queries over the test tables; importing the modules fills the registry."""

from scenarios import catalogue, ingesting, quality, resampling, scoring, stages, training  # noqa: F401
from scenarios.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
