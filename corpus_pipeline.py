"""The training-data pipeline: STAGES over documents, run() and its SQL."""

from scribe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
