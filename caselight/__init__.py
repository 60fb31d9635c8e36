"""Document-operations and call-quality analytics on PySpark DataFrames."""
