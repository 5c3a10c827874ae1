"""Ingestion of new files as a stream."""
