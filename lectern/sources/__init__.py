"""Readers and writers: markup corpora, node JSON, the per-method store."""
