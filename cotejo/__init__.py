"""cotejo: catalogue search, price aggregation and corpus analytics on PySpark DataFrames."""
