"""Readers that turn text, codes and packed bytes into sequences, and graph writers."""
