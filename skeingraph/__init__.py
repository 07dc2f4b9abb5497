"""skeingraph: typed graph-shaped queries and batch pipelines on PySpark DataFrames."""
