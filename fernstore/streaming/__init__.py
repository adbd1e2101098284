"""Change feeds, listeners and the outbox on Structured Streaming."""
