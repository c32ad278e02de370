"""routeloom: captured HTTP traffic woven into a typed route tree, on Spark DataFrames."""
