"""Structured Streaming jobs: sessions, ingestion, questions."""
