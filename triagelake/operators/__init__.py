"""triagelake.operators."""
