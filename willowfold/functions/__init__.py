"""Column expressions: cleaning, labels, bands and percentiles."""
