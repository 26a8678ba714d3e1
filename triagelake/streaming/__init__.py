"""triagelake.streaming."""
