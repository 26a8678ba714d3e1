"""triagelake: Spark-native script-triage analytics.

Every operator is a function from DataFrames to a DataFrame.  The driver only
ever sees scalars, bounded statistics and plans, never rows of the corpus.
"""

__version__ = "0.1.0"
