"""rankfold: personalised item ranking as Spark DataFrame jobs.

Sub-packages:
  sources    readers for CSV / JSON / Parquet / JDBC, driver-table views, model stores
  functions  column-level helpers (weights, JSON lookups, vector math)
  operators  relational and model operators (validation, fold, ranking, models)
  plans      named queries used by the entry module and the benchmark
  streaming  Structured Streaming forms of the continuous operators
"""

from rankfold.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
