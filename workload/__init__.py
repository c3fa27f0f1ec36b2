"""Queries over the driver's tables, with SQL that states the expected result of each."""

from workload import (  # noqa: F401
    q_anomaly,
    q_egress,
    q_graph,
    q_inventory,
    q_policy,
    q_remediation,
    q_scalars,
    q_sources,
    q_streaming,
    q_traffic,
)
from workload.registry import EXPECTED, QUERIES

__all__ = ["EXPECTED", "QUERIES"]
