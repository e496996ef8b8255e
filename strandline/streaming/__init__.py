"""The same counts on streams as on batches, with Structured Streaming."""
