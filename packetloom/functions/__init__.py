"""Column expressions: coercions, packet fields, histograms and quantiles."""
