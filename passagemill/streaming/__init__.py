"""The ingest job as a Structured Streaming query."""
