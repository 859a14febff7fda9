"""Sources and sinks: the append-only raw log, thread pages, social posts, fixtures."""
