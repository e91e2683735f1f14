"""Whole jobs, from files to files: extraction, window features, builder, post-processing, conversion."""
