from .streams import (  # noqa: F401
    event_stream, run_available, stream_insert_ignore, stream_window_counts, stream_standings,
    stream_standings_live, stream_apply_changes, stream_asof, stream_fallback, stream_retained, latest_versions,
)
