"""The sequential operators on Structured Streaming."""
