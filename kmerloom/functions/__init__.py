"""Column functions over bases, sequences, k-mers and extension sets."""
