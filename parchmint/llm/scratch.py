"""Intermediate tables of the training-text operators: the library's own."""

from __future__ import annotations

from parchmint.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
