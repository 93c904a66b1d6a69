"""Column functions: DNA strings, k-mers, hashes, positions, names, CIGARs."""
