"""Retrieval-augmented classification data on Spark: claims, corpus, BM25, posteriors, evidence selection."""
