"""Streams as a source of inserts."""

from .ingest import ingest

__all__ = ["ingest"]
