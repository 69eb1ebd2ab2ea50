"""Cleaning, profiling, partitioned storage, reports and regression for tabular data on Spark."""

from millrace.session import spark_session, use_utc

__all__ = ["spark_session", "use_utc"]
