"""Point-in-time fundamentals analytics on PySpark."""
