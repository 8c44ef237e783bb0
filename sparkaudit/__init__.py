"""Data-quality analytics for listing-style tables, as Spark DataFrame jobs."""
