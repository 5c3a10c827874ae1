"""Sinks: JSON, Markdown, HTML and console."""
