"""Record linkage and quote analytics on Spark DataFrames."""
