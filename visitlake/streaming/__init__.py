"""Structured Streaming forms of the reference's session and visitor logic (its service is batch-only)."""

from visitlake.streaming.sessions import run_session_stream, stream_session_summary
from visitlake.streaming.visitors import run_visitors_stream, stream_visitors_by_source_date

__all__ = ["run_session_stream", "stream_session_summary", "run_visitors_stream", "stream_visitors_by_source_date"]
