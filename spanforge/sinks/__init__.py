"""Sinks: Markdown, summaries."""
