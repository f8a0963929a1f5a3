"""The corpus pipeline: STAGES, run(spark, sf_dir) and ORACLE_SQL; gleaner/llm/pipeline.py holds them."""

from gleaner.llm.pipeline import COLUMNS, ORACLE_SQL, REDACTED, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "REDACTED", "STAGES", "run"]
