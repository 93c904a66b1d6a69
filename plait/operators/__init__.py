"""Operators over haplotype graphs held as DataFrames."""
