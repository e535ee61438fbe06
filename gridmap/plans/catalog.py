"""All registered queries (importing a module registers its queries)."""

from gridmap.plans import queries  # noqa: F401
from gridmap.plans import queries_cells  # noqa: F401
from gridmap.plans import queries_pipeline  # noqa: F401
from gridmap.plans import queries_misc  # noqa: F401
from gridmap.plans import queries_sources  # noqa: F401
from gridmap.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
