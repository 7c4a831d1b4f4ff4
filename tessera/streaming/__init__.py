"""Structured Streaming extensions (the survey lists no streaming operator to match)."""
