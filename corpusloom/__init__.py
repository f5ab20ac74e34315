"""A corpus search and index engine on PySpark."""
