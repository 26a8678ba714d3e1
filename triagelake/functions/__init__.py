"""triagelake.functions."""
