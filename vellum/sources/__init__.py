"""Readers and writers: files and archives, LaTeX, reports, registry runs, logs."""
