"""Source-graph analytics and data processing on Spark."""
