"""reclink: research-record linkage on Spark.

Every public operator takes and returns DataFrames or Columns; the heavy work
(parsing, curation, kNN joins, evaluation aggregates) runs as Spark jobs.
"""

from reclink.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
