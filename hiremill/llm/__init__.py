"""Operators for training-data corpora: documents, web pages and embeddings. Nothing else in the library imports this package."""
