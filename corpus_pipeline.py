"""Training-data pipeline over `documents`: see motionloom.llm.pipeline."""

from __future__ import annotations

from motionloom.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
