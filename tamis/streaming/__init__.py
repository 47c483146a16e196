"""Structured Streaming twins of the batch jobs: incremental ingest, dedup, first writes, streaks, follow-ups."""
