"""All queries of the engine with their DuckDB SQL."""

from stratalex.plans import analyses, composed, matching, models, morphology, platform, profiles, sequences, solver, sources, statistics  # noqa: F401
from stratalex.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
