"""Continuous ingest: every batch of source files updates the stored graph."""

from __future__ import annotations

from graphlens.plans.live import apply_batch, read, refine

__all__ = ["apply_batch", "read", "refine"]
