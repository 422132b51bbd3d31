"""All queries of the library proper."""

from __future__ import annotations

from dossier.plans import control, retrieval, texts  # noqa: F401  each registers its queries
from dossier.plans.registry import ORACLES, QUERIES
from dossier.plans.retrieval import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
