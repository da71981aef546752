"""Column functions: decimal rounding parity and rates, Python-style flag
truthiness, text normalisation and display rules, bands and classifications.
All are native Spark expressions (no UDFs)."""
