"""Operators: lazy DataFrame -> DataFrame functions, grouped by analysis area."""

from . import analyze, breakdown, cells, clean, geo, profile, trend  # noqa: F401
