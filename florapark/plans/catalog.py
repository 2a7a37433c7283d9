"""Imports every query module, so that the registry is complete."""

from florapark.plans import evaluation, modelling, places, records, runs, training  # noqa: F401
from florapark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
