"""Event modes as Structured Streaming jobs."""
