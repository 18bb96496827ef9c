"""Package of data sources."""
