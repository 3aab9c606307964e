"""tidelog: keyed change-log analytics on Spark DataFrames."""
