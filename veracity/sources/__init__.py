"""Sources: parquet tables, claims-shaped views, snapshot operators."""
