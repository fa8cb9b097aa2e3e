"""Time-series ETL and analytics on Spark DataFrames."""
