"""Structured Streaming ingest of arriving CDX files."""

from .ingest import ingest_stream  # noqa: F401
