"""Operators for preparing training data: cleaning, deduplication, scoring, tokens, shards."""
