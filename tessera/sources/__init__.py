"""Readers and sinks: files, parsers, document and vector stores."""
