"""Imports every module that registers queries."""

from .registered import content_queries, dep_queries, history_queries, job_queries, manifest_queries, report_queries, scalar_queries, scans, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
