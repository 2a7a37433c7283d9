"""Species-distribution data preparation and evaluation on PySpark DataFrames."""
