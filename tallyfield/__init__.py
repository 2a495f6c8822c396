"""Season and challenge analytics on PySpark DataFrames."""
