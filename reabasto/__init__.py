"""Replenishment analytics as Spark jobs."""

from reabasto.params import Params

__all__ = ["Params"]
