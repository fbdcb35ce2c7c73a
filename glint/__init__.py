"""glint: reflectometry analytics on PySpark."""
