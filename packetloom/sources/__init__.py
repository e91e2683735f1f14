"""Readers and writers: packet JSON in both layouts, damaged files included; feature files; documents of a run."""
