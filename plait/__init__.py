"""plait: haplotype-graph and sequence analytics on Spark DataFrames."""
