"""millrace: catalogue de-duplication, grouping and organising as PySpark DataFrame transformations."""
