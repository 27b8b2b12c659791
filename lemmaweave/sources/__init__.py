"""Sources of documents and tables."""
