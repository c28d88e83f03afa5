"""The query catalogue and the method registry."""
