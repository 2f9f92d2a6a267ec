"""Customer attrition analytics on Spark DataFrames."""
