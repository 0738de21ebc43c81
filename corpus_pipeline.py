"""The corpus pipeline, kept in ridgeline.llm.pipeline and deleted along with it."""

from ridgeline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
