"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from kinweave.operators.components import linked as components

__all__ = ["components"]
