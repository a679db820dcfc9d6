"""All registered queries, grouped by subject."""

from tablescope.catalog import aggregates, cells, composites, learning, ordered, schema, sources  # noqa: F401
from tablescope.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
