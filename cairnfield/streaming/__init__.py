"""Incremental upkeep with Structured Streaming (an extension: the batch engine needs none)."""
