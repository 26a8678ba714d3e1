"""triagelake.plans."""
