"""Structured Streaming forms of intake, windowed counts and drift."""
