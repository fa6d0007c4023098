"""DataFrame operators: filters, chunking, retrieval, fusion, evidence, lifecycle, analytics."""
