"""All registered queries."""

from __future__ import annotations

from . import details, documentary, orchestration, relational, reporting, structured, textual  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
