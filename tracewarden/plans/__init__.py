"""The queries of the engine, by theme."""

from tracewarden.plans import decisions, diagnosis, episodes, evidence, features, graphs, interval_algebra, streams  # noqa: F401
from tracewarden.plans.registry import QUERIES, SQL  # noqa: F401
