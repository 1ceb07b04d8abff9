"""The corpus pipeline as the driver looks for it; its stages are in `corvellum.llm.stages`."""

from corvellum.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
