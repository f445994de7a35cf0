"""All panel queries: the registry that the query modules fill."""

from __future__ import annotations

from panelspark.registry import Registry

REGISTRY = Registry()
