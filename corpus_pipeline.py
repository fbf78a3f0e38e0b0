"""The corpus pipeline: its stages, the SQL they have, and a run over all of them."""

from stratalex.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
