"""Incremental ingestion: files that arrive in a folder become document rows, batch by batch."""

from .ingest import ingest_files, ingest_once

__all__ = ["ingest_files", "ingest_once"]
