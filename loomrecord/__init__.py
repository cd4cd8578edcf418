"""Event-record analytics on Spark: dynamic JSON records as DataFrame jobs."""

from loomrecord.session import configure, new_session, scratch_dir

__all__ = ["configure", "new_session", "scratch_dir"]
