"""From documents to token ids: quality classifier, line dedup, near-dedup, benchmark decontamination, BPE.

SQL cannot express the classifier, so there is no SQL for the rows; tests hold each stage against brute force.
"""

from axleyard.llm.stages import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
