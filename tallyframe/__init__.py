"""Analytics over public-sector facts, policy texts and entity graphs, on Spark DataFrames."""
