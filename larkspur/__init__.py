"""Larkspur: a data-analyst toolkit on Spark DataFrames.

Ingest, profile, clean, chart, train and query, each stage taking and returning DataFrames.
"""

from larkspur.session import build_session, shared_path

__all__ = ["build_session", "shared_path"]
