"""Live versions of batch operators on Structured Streaming."""
