"""Reading and writing: separated text, Parquet, JSON, arrays, listings."""
