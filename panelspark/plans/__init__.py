"""Queries on the panel, by subject. Importing this package registers them all."""

import importlib

from panelspark.plans.catalogue import REGISTRY

for _subject in ("window_queries", "quality_queries", "diagnostic_queries", "universe_queries", "factor_queries", "book_queries", "trading_queries", "candidate_queries", "recursive_queries", "stream_queries", "fold_queries", "file_queries", "layout_queries"):
    importlib.import_module(f"panelspark.plans.{_subject}")

__all__ = ["REGISTRY"]
