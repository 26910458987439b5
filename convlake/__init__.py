"""convlake: a PySpark toolkit for AI conversation logs and training-text preparation."""
