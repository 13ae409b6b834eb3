"""Operators for preparing training data: extraction, filtering, deduplication, scoring and tokenization."""
