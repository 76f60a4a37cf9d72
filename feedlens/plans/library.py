"""All registered plans; importing a plan module registers its queries."""

from feedlens.plans import aggregates, changes, documents, kept, landed, ranking, relational, scalars  # noqa: F401
from feedlens.plans.registry import COVERS, QUERIES, SQL

__all__ = ["COVERS", "QUERIES", "SQL"]
