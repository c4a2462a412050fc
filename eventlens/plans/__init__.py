"""Named analysis plans (Spark builder + independent oracle SQL per operator)."""

from .registry import PLANS, Plan  # noqa: F401
