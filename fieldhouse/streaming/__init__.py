"""Live snapshots with Structured Streaming."""
