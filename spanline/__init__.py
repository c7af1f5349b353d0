"""Event-timeline analytics on Spark DataFrames."""
