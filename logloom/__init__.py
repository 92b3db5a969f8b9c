"""logloom: log-template analytics as Spark DataFrame jobs.

Raw log lines become structured rows (header columns + message), every
message gets a template whose variable parts are ``<*>``, and parses are
scored against ground truth.  Every public function takes and returns
DataFrames; nothing is collected to the driver except small, size-checked
tables (template tables before a broadcast, counts in a fixpoint loop).
"""

from logloom.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
