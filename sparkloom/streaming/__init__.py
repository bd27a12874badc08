"""Applying fitted state to streams."""

from .impute import impute_stream, missing_counts

__all__ = ["impute_stream", "missing_counts"]
