"""All registered queries."""

from plumbline.plans import (  # noqa: F401
    bound_behavior,
    bound_compare,
    bound_labels,
    bound_lineage,
    bound_mapping,
    bound_profile,
    bound_quality,
    bound_skew,
)
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
