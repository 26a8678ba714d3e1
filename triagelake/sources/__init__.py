"""triagelake.sources."""
