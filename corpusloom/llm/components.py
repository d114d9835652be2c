"""Connected components, for the operators here."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
