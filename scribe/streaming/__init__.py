"""Structured Streaming jobs: rolling request statistics, job progress, early-stop alerts, incremental ingest."""
