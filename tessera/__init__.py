"""Tessera: document-retrieval analytics on Spark DataFrames."""
