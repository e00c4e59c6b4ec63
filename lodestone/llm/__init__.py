"""Operators of a training-data pipeline: repeats, archives, tokens, near copies,
personal data, benchmark leaks, toxicity, shards, text search, page text,
periodic runs, whitening and language models."""
