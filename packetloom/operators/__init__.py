"""Relational operators: inter-arrival times, windows, sessions, feature aggregates, post-processing."""
