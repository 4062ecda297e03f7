"""A relational engine on Spark: a small SQL dialect compiled to DataFrames, over versioned Parquet tables."""
