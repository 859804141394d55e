"""Source-code attribution and training-data analytics on Spark."""
