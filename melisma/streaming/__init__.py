"""Streaming versions of operators that Spark can run incrementally."""
