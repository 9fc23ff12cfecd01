"""All registered queries; importing a module registers its queries."""

from pagemill.plans import grid_queries, line_queries, match_queries, scalar_queries, source_queries  # noqa: F401
from pagemill.plans.registry import ORACLES, QUERIES  # noqa: F401
