"""Structured Streaming forms of ingestion, metrics, rate limits and de-duplication."""
