"""Structured Streaming: exact rate limits, daily counts, votes."""
