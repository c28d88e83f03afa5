"""Structured Streaming: snapshots and latest values."""
