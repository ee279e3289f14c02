"""graphloom: code property graph analytics on Spark DataFrames."""
