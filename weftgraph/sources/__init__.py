"""Reading and writing graphs as delimited text or Parquet."""
