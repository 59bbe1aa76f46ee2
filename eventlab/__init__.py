"""Event tables on Spark."""
