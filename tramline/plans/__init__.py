"""Every query of the reference's operators, on the driver's tables."""

from tramline.plans import joins, lookups, measures, more, planning, scalars, sources, supporting  # noqa: F401
from tramline.plans.base import REGISTRY, SQL

__all__ = ["REGISTRY", "SQL"]
