"""The operators that also run on unbounded input."""

from devicelode.streaming.streams import (  # noqa: F401
    dedupe_stream, first_rows, fold_status_stream, ingest_stream, latest_status_stream, latest_table, rate_audit_stream,
    start_dedupe, start_keyed, usage_stream,
)
