"""Operators of a training-data pipeline: documents, pages and embeddings at corpus size."""
