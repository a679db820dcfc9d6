"""Automatic table analysis on Spark: detect, check, clean, derive, explore, model."""

from tablescope.options import Options
from tablescope.plans.analyze import Report, analyze, exploration, run_analysis
from tablescope.plans.roles import Roles, detect
from tablescope.sources.tables import read_table, write_table

__all__ = ["Options", "Report", "Roles", "analyze", "detect", "exploration", "read_table",
           "run_analysis", "write_table"]
