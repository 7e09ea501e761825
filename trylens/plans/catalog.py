"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from . import (  # noqa: F401  (imported for their registrations)
    catalog_clean,
    catalog_encode,
    catalog_labels,
    catalog_metrics,
    catalog_models,
    catalog_quarantine,
    catalog_slicing,
    catalog_source_tree,
    catalog_sources,
    catalog_streaming,
    catalog_structure,
)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
