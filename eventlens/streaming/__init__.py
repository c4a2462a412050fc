"""Structured Streaming: incremental landing of new raw files."""

from .landing import finalize_landed, landed_rows, read_landing_stream, rejected_rows, start_landing, start_rejects  # noqa: F401
