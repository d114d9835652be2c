"""The shared-folder tables of the library, for the operators here."""

from __future__ import annotations

from ..sources.shared import fresh_path, removed, shared_dir, written

__all__ = ["fresh_path", "removed", "shared_dir", "written"]
