"""Connected components of the classes of texts: the graph operators of the library, under the names used here."""

from __future__ import annotations

from ..operators.graph import components, merged

__all__ = ["components", "merged"]
