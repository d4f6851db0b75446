"""Imports every module that registers queries."""

from screenlab.plans import (  # noqa: F401
    flagship,
    genome,
    loading,
    near,
    panels,
    ranking,
    screens,
    sequences,
    splits,
    sweeps,
    tables,
    training,
)
from screenlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
