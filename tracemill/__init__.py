"""tracemill: session and event-log analytics on PySpark DataFrames."""
