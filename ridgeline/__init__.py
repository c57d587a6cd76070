"""ridgeline: batch building-roof measurement and table analytics on Spark DataFrames."""
