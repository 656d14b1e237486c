"""Listening-trend analytics as plain Spark DataFrame functions."""

from .params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
