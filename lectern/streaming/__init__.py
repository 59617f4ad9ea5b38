"""Incremental ingestion with Structured Streaming (an extension: nothing streams in the batch engine)."""
