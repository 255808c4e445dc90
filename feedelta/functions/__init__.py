"""Column expressions: tolerant equality and CSV rendering. No Python UDFs."""
