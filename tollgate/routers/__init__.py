"""Routing policies.

A policy is fitted on train items (``item_id``, features ``x``, ``perf`` and
``cost`` in model order) and adds ``perf_pred`` and ``cost_pred`` to test items.
"""

from tollgate.routers.cluster import ClusterPolicy
from tollgate.routers.linear import LinearPolicy, LowRankPolicy
from tollgate.routers.nearest import NearestPolicy
from tollgate.routers.neural import CrossModalPolicy, NetFactorPolicy, NetPolicy

__all__ = [
    "ClusterPolicy",
    "CrossModalPolicy",
    "LinearPolicy",
    "LowRankPolicy",
    "NearestPolicy",
    "NetFactorPolicy",
    "NetPolicy",
]
