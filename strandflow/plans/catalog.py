"""Named queries over the driver's tables, and the SQL that checks them."""

from strandflow.plans import assemblies, graphs, reports  # noqa: F401  they register their queries
from strandflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
