"""Policy and tracking audit as Spark jobs."""

from clausetrail.session import build_session

__all__ = ["build_session"]
