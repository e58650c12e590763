"""From raw documents to packed training sequences, stage by stage."""

from plotweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
