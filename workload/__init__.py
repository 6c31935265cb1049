"""The operators of graphlens bound to the test tables, each beside its SQL."""

from workload import feeds, graph, ingest, search, service, streams  # noqa: F401
from workload.harness import ORACLES, QUERIES  # noqa: F401
