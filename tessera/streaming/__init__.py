"""Structured Streaming adapters for ingestion."""
