"""linkloom: link graphs, text statistics and topic models of crawled web sites, as Spark DataFrames."""
