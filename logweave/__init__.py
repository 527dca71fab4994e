"""Event-log analytics on Spark: the log is a DataFrame, every query a DataFrame -> DataFrame function."""
