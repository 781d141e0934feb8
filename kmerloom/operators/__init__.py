"""Relational operators: k-mer counting, extension repair, sharding, compaction, graphs."""
