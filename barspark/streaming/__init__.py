"""Streams of minute bars, on Structured Streaming."""

from barspark.streaming.ingest import IngestConfig, ingest_batch, replay

__all__ = ["IngestConfig", "ingest_batch", "replay"]
