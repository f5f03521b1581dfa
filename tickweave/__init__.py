"""A market-microstructure analytics engine on Spark."""
