"""Registered queries, family by family, each with its SQL oracle."""

from . import analytics, chunks, classifying, evaluating, extracting, filtering, hybrid, incremental, learning, matching, relating, searching, selecting, sources, state, stored, variants
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "chunks", "classifying", "evaluating", "extracting", "filtering", "hybrid", "incremental", "learning", "matching", "relating", "searching", "selecting", "sources", "state", "stored", "variants"]
